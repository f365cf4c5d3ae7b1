"""Catalog operators: ingest, tags and their bridges, filters, integrity. Every function takes and returns DataFrames."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shoebox.operators.grams import candidates, containing
from shoebox.operators.numbering import numbered

#: File suffixes of pictures.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tiff", "tif", "webp")
GALLERY_SUFFIXES = ("jpg", "jpeg", "png")
ARCHIVE_SUFFIXES = ("jpg", "jpeg", "png", "gif", "bmp", "webp")
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png"}
IMPORT_FIELDS = ("name", "url", "source_url", "date", "year", "original_filename", "actors", "tags")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rn = 1").drop("_rn")


# ingest ---------------------------------------------------------------------------------------------------------------


def discover_images(files: DataFrame, gallery: bool = False, path: str = "path") -> DataFrame:
    """Rows whose path is a picture; the gallery form leaves out crops and hidden files."""
    name = base_name(F.col(path))
    if not gallery:
        return files.filter(suffix(F.col(path)).isin(*IMAGE_SUFFIXES))
    return files.filter(suffix(F.col(path)).isin(*GALLERY_SUFFIXES) & ~name.contains("_crop_") & ~name.startswith("."))


def split_crop_files(files: DataFrame, path: str = "path") -> DataFrame:
    return files.filter(base_name(F.col(path)).contains("_crop_"))


def photoset_year(date: Column) -> Column:
    """'Month D, YYYY' to its year as text; null without a comma."""
    return F.try_element_at(F.split(date, ", "), F.lit(2))


def archive_name(path: Column) -> Column:
    return F.trim(F.translate(stem(path), "_-", "  "))


def archive_entries(entries: DataFrame, name: str = "entry") -> DataFrame:
    """Picture entries of archive listings, by base name; resource forks are left out."""
    kept = entries.filter(suffix(F.col(name)).isin(*ARCHIVE_SUFFIXES) & ~F.col(name).contains("__MACOSX"))
    return kept.withColumn("file_name", base_name(F.col(name)))


def tag_dimension(rows: DataFrame, order: str = "ord") -> DataFrame:
    """(name, tag_type), names unique: the type seen first in ingest order stays."""
    return rows.groupBy("name").agg(F.min_by("tag_type", F.struct(order, "tag_type")).alias("tag_type"))


def bridge_add(bridge: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    return bridge.select(*keys).unionByName(more.select(*keys)).dropDuplicates(list(keys))


def bridge_remove(bridge: DataFrame, gone: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(what stays, the asked-for pairs with whether they existed)."""
    asked = gone.select(*keys).distinct()
    had = asked.join(bridge.select(*keys).distinct().withColumn("existed", F.lit(True)), list(keys), "left")
    return bridge.join(asked, list(keys), "left_anti"), had.withColumn("existed", F.coalesce("existed", F.lit(False)))


def inverted_index(rows: DataFrame) -> DataFrame:
    """(kind, value) to the sorted set of scenes; ``rows`` is long: kind, value, scene."""
    return rows.filter("value is not null").groupBy("kind", "value").agg(F.array_sort(F.collect_set("scene")).alias("scenes"))


def match_directory(sets: DataFrame, directories: DataFrame) -> DataFrame:
    """(id, directory): the first candidate name of each set that exists. ``sets`` has id, stem, name, original_filename."""
    plain = [F.col("stem"), F.col("name"), stem(F.col("original_filename"))]
    forms = F.array(*plain, *[F.translate(c, "_", " ") for c in plain], *[F.translate(c, " ", "_") for c in plain])
    named = sets.select("id", F.posexplode(F.array_distinct(F.filter(forms, lambda x: x.isNotNull()))).alias("pos", "directory"))
    found = named.join(directories.select("directory").distinct(), "directory")
    return found.groupBy("id").agg(F.min_by("directory", "pos").alias("directory"))


def scan_report(sets: DataFrame, matches: DataFrame, files: DataFrame) -> DataFrame:
    """(id, directory, n_images, matched) for every set; ``files`` has directory."""
    counts = files.groupBy("directory").agg(F.count("*").alias("n_images"))
    return (
        sets.select("id").join(matches, "id", "left").join(counts, "directory", "left")
        .select("id", "directory", F.coalesce("n_images", F.lit(0)).alias("n_images"), F.col("directory").isNotNull().alias("matched"))
    )


def new_images(files: DataFrame, images: DataFrame) -> DataFrame:
    """Files whose path the catalog does not have, with name and MIME type."""
    fresh = files.join(images.select("file_path"), "file_path", "left_anti")
    return fresh.withColumns({"filename": base_name(F.col("file_path")), "mime_type": F.concat(F.lit("image/"), suffix(F.col("file_path")))})


def import_status(incoming: DataFrame, known: DataFrame, images: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, status) of each incoming set against known sets, their images and matched directories."""
    counts = images.groupBy(F.col("photoset_id").alias("id")).agg(F.count("*").alias("n"))
    j = (
        incoming.select("id").join(known.select("id", F.lit(True).alias("known")), "id", "left")
        .join(counts, "id", "left").join(matches.select("id", "directory"), "id", "left")
    )
    old = F.coalesce("known", F.lit(False))
    status = (
        F.when(old & (F.coalesce("n", F.lit(0)) > 0), "skipped").when(old, "images_added")
        .when(F.col("directory").isNull(), "created_without_directory").otherwise("imported")
    )
    return j.select("id", status.alias("status"))


def upsert_latest(changes: DataFrame, key: str, order: Sequence[str], created: str) -> DataFrame:
    """One row for each key: the latest change's columns, with the first change's ``created``."""
    last = F.struct(*order)
    rest = [c for c in changes.columns if c not in (key, created)]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), last).alias("_last"), F.min(created).alias(created)).select(key, created, *[F.col(f"_last.{c}").alias(c) for c in rest])


def update_by_id(rows: DataFrame, patch: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the given columns taken from the patch where it has the key (nulls in the patch do overwrite)."""
    new = patch.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    j = rows.join(new, key, "left")
    out = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns]
    return j.select(*out)


def cascade_delete(gone_sets: DataFrame, images: DataFrame, dependants: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What stays of images and of each table keyed by image_id, when photosets (id) are deleted."""
    gone = gone_sets.select(F.col("id").alias("photoset_id"))
    dead = images.join(gone, "photoset_id", "left_semi").select(F.col("id").alias("image_id"))
    out = {"images": images.join(gone, "photoset_id", "left_anti")}
    return out | {k: d.join(dead, "image_id", "left_anti") for k, d in dependants.items()}


def merge_image_tags(old: DataFrame, new: DataFrame) -> DataFrame:
    """(image_id, tags): union of both tables' (image_id, tag), sorted, distinct."""
    return old.select("image_id", "tag").unionByName(new.select("image_id", "tag")).groupBy("image_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


# filters and projections --------------------------------------------------------------------------------------------------


def has(images: DataFrame, other: DataFrame, wanted: bool, key: str = "id", other_key: str = "image_id") -> DataFrame:
    keys = other.select(F.col(other_key).alias(key))
    return images.join(keys, key, "left_semi" if wanted else "left_anti")


def apply_filters(
    images: DataFrame, scenes: DataFrame | None = None, scene_tags: DataFrame | None = None, image_tags: DataFrame | None = None,
    captions: DataFrame | None = None, crops: DataFrame | None = None, actors: DataFrame | None = None, *,
    actor: str | None = None, tag: str | None = None, year: int | None = None, has_caption: bool | None = None, has_crop: bool | None = None,
) -> DataFrame:
    """All given predicates hold; a tag counts if the scene or the image has it. ``images`` has id and scene."""
    out = images
    if actor is not None:
        out = out.join(actors.filter(F.col("actor") == actor).select("scene"), "scene", "left_semi")
    if year is not None:
        out = out.join(scenes.filter(F.col("year") == year).select("scene"), "scene", "left_semi")
    if tag is not None:
        by_scene = out.join(scene_tags.filter(F.col("tag") == tag).select("scene"), "scene", "left_semi").select("id")
        by_image = image_tags.filter(F.col("tag") == tag).select(F.col("image_id").alias("id"))
        out = out.join(by_scene.unionByName(by_image), "id", "left_semi")
    if has_caption is not None:
        out = has(out, captions, has_caption)
    if has_crop is not None:
        out = has(out, crops, has_crop)
    return out


def combined_tags(scene_tags: Column, image_tags: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(scene_tags, none), F.coalesce(image_tags, none)))


def mime_type(path: Column) -> Column:
    kind = suffix(path)
    return F.coalesce(*[F.when(kind == k, v) for k, v in MIME.items()], F.lit("application/octet-stream"))


def image_metadata(images: DataFrame, captions: DataFrame, crops: DataFrame, scene_tags: DataFrame, image_tags: DataFrame, collection: str = "gallery") -> DataFrame:
    """Listing rows: flags, MIME type and combined tags of each image (id, scene, file_path)."""
    by_scene = scene_tags.groupBy("scene").agg(F.collect_set("tag").alias("_s"))
    by_image = image_tags.groupBy(F.col("image_id").alias("id")).agg(F.collect_set("tag").alias("_i"))
    j = (
        images.join(captions.select(F.col("image_id").alias("id"), F.lit(True).alias("_cap")).distinct(), "id", "left")
        .join(crops.select(F.col("image_id").alias("id"), F.lit(True).alias("_crop")).distinct(), "id", "left")
        .join(by_scene, "scene", "left").join(by_image, "id", "left")
    )
    tags = combined_tags(F.col("_s"), F.col("_i"))
    return j.select(
        "id", F.lit(collection).alias("collection_name"), mime_type(F.col("file_path")).alias("mime_type"),
        F.coalesce("_cap", F.lit(False)).alias("has_caption"), F.coalesce("_crop", F.lit(False)).alias("has_crop"),
        (F.size(tags) > 0).alias("has_tags"), F.col("_i").isNotNull().alias("has_custom_tags"), tags.alias("tags"),
    )


def tags_of(bridge: DataFrame, tags: DataFrame, key: str = "image_id", kind: str | None = None) -> DataFrame:
    """(key, name, tag_type) by name; of one type if asked."""
    kept = tags if kind is None else tags.filter(F.col("tag_type") == kind)
    return bridge.join(kept, "name").select(key, "name", "tag_type").orderBy(key, "name")


def images_by_tag(images: DataFrame, bridge: DataFrame, tag: str) -> DataFrame:
    wanted = bridge.filter(F.col("name") == tag).select(F.col("image_id").alias("id"))
    return images.join(wanted, "id", "left_semi")


def file_names() -> Column:
    """Name and path as one text, for a name index of images."""
    return F.concat_ws("\n", "filename", "file_path")


def find_by_pattern(images: DataFrame, pattern: str, index: str | None = None) -> DataFrame:
    """The image with that id, if the pattern is a UUID; else the smallest id whose name or path contains it.

    ``index`` is the path of a name index over ``file_names``; with it, only images that have the pattern's runs are read."""
    uuid = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    if index and not re.match(uuid, pattern):
        named = candidates(images.sparkSession, index, [pattern])
        images = images if named is None else images.join(named, "id", "left_semi")
    hit = F.when(F.lit(pattern).rlike(uuid), F.col("id").cast("string") == pattern).otherwise(F.col("filename").contains(pattern) | F.col("file_path").contains(pattern))
    return images.filter(hit).orderBy("id").limit(1)


def size_guard(images: DataFrame, max_bytes: int, max_pixels: int) -> DataFrame:
    return images.filter(~(F.col("file_size") > max_bytes) & ~(F.col("width").cast("long") * F.col("height") > max_pixels))


def windows_path(path: Column) -> Column:
    """/mnt/<drive>/… to <DRIVE>:\\…; other paths unchanged."""
    drive = F.regexp_extract(path, r"^/mnt/([a-z])/", 1)
    rest = F.translate(F.regexp_replace(path, r"^/mnt/[a-z]/", ""), "/", "\\")
    return F.when(drive != "", F.concat(F.upper(drive), F.lit(":\\"), rest)).otherwise(path)


def copy_plan(wanted: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(path, status): skip without suffix, fail if missing, skip if the target exists, else ok."""
    j = (
        wanted.select("path").join(source.select("path", F.lit(True).alias("_src")).distinct(), "path", "left")
        .join(target.select("path", F.lit(True).alias("_dst")).distinct(), "path", "left")
    )
    status = F.when(suffix(F.col("path")) == "", "skip").when(F.col("_src").isNull(), "fail").when(F.col("_dst").isNotNull(), "skip").otherwise("ok")
    return j.select("path", windows_path(F.col("path")).alias("windows_path"), status.alias("status"))


def config_id(model: Column, pretrained: Column, resolution: Column, mode: Column) -> Column:
    short = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    return F.concat_ws("_", short(model), short(pretrained), resolution.cast("string"), short(mode))


def compatible_configs(registry: DataFrame, own: dict, fields: Sequence[str]) -> DataFrame:
    """Registered configurations equal to ``own`` in all ``fields``, its own id first."""
    same = registry
    for f in fields:
        same = same.filter(F.col(f).eqNullSafe(F.lit(own[f])))
    return numbered(same, [], [(F.col("config_id") != own["config_id"]).cast("int"), "config_id"], "preference")


def scene_of_image(images: DataFrame, scenes: DataFrame, longest: bool = False) -> DataFrame:
    """(image_id, scene): the first scene key, in order of keys, that the image id contains; or the longest."""
    pairs = containing(images.select("image_id"), scenes, "image_id", "scene")
    order = F.struct((-F.length("scene") if longest else F.lit(0)).alias("a"), F.col("scene").alias("b"))
    return pairs.groupBy("image_id").agg(F.min_by("scene", order).alias("scene"))


# integrity --------------------------------------------------------------------------------------------------------------


def orphan_images(images: DataFrame, photosets: DataFrame) -> DataFrame:
    return images.join(photosets.select(F.col("id").alias("photoset_id")), "photoset_id", "left_anti")


def absent(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key the others do not have: files without rows, rows without files."""
    return rows.join(others.select(key), key, "left_anti")


def thumbnail_coverage(images: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """One row: expected, present, missing, coverage and its band (good at 90 %, partial at 50 %)."""
    have = images.join(thumbnails.select(F.col("image_id").alias("id"), F.lit(1).alias("t")).distinct(), "id", "left")
    counts = have.agg(F.count("*").alias("expected"), F.count("t").alias("present"))
    cover = F.when(F.col("expected") > 0, F.col("present") / F.col("expected")).otherwise(0.0)
    band = F.when(cover >= 0.9, "good").when(cover >= 0.5, "partial").otherwise("poor")
    return counts.select("expected", "present", (F.col("expected") - F.col("present")).alias("missing"), F.round(cover, 6).alias("coverage"), band.alias("band"))


def export_manifest(ids: DataFrame, images: DataFrame, crops: DataFrame, captions: DataFrame) -> DataFrame:
    """For each known requested id its file name, crop path and caption, if any."""
    return (
        images.join(ids.select("id"), "id", "left_semi").join(crops.select(F.col("image_id").alias("id"), "crop_file_path"), "id", "left")
        .join(captions.select(F.col("image_id").alias("id"), "caption"), "id", "left").select("id", base_name(F.col("file_path")).alias("name"), "crop_file_path", "caption")
    )
