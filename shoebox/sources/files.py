"""Sources and sinks: side files of a picture collection, vectors, poses and feature stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shoebox.operators import catalog as C
from shoebox.operators.vectors import pad_by_method


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of all files below; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def parse_photoset_json(rows: DataFrame, text: str = "json") -> tuple[DataFrame, DataFrame]:
    """(rows with actors, tags, date, year; rows whose text is no such JSON). Other columns stay."""
    schema = "actors array<string>, tags array<string>, date string, _corrupt string"
    parsed = rows.withColumn("_p", F.from_json(F.col(text), schema, {"columnNameOfCorruptRecord": "_corrupt"})).drop(text)
    bad = F.col("_p").isNull() | F.col("_p._corrupt").isNotNull()
    good = parsed.filter(~bad).select("*", "_p.actors", "_p.tags", "_p.date").drop("_p").withColumn("year", C.photoset_year(F.col("date")))
    return good, parsed.filter(bad).drop("_p")


def read_photoset_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(photosets with scene = file stem, actors, tags, date, year; rejected files), one file a photoset."""
    return parse_photoset_json(spark.read.text(path, wholetext=True).select(C.stem(F.col("_metadata.file_name")).alias("scene"), F.col("value").alias("json")))


def parse_import_json(rows: DataFrame, text: str = "json") -> DataFrame:
    """Import rows from JSON text: known fields typed, url from either field, a bad date null, the rest in extra_metadata."""
    bag = F.from_json(F.col(text), "map<string,string>")
    lists = F.from_json(F.col(text), "struct<actors:array<string>,tags:array<string>>")
    rest = F.map_filter("_bag", lambda k, v: ~k.isin(*C.IMPORT_FIELDS))
    return (
        rows.withColumn("_bag", bag).withColumn("_lists", lists)
        .withColumns({
            "name": F.col("_bag")["name"], "source_url": F.coalesce(F.col("_bag")["url"], F.col("_bag")["source_url"]), "date": F.try_to_date(F.col("_bag")["date"], "yyyy-MM-dd"),
            "year": F.col("_bag")["year"].try_cast("int"), "original_filename": F.col("_bag")["original_filename"], "actors": F.col("_lists.actors"), "tags": F.col("_lists.tags"), "extra_metadata": rest,
        }).drop("_bag", "_lists")
    )


def read_import_json(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(import rows with their path, rejected texts), one object a file or, with ``lines``, one a line."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=not lines).filter(F.col("value").rlike(r"\S"))
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    is_object = F.try_parse_json("json").isNotNull() & F.col("json").rlike(r"^\s*\{")
    return parse_import_json(rows.filter(is_object)).drop("json"), rows.filter(~is_object)


def stripped(text: Column) -> Column:
    """Text without white space at either end, line ends included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def captions_of(files: DataFrame) -> DataFrame:
    """(path, image_id, caption) of <id>_caption.txt files given as (path, value); other files are left out.

    The file's name may also be that of a folder with one file in it, as partitioned writers lay it out."""
    key = F.regexp_extract("path", r"([^/=]+)_caption\.txt(/[^/]+)?$", 1)
    return files.select("path", key.alias("image_id"), stripped(F.col("value")).alias("caption")).filter("image_id <> ''")


def crops_of(files: DataFrame) -> DataFrame:
    """(path, image_id, target_size, delta_x, delta_y) of <id>_crop_<size>.json files given as (path, value); what is no such
    JSON is left out."""
    key = F.regexp_extract("path", r"([^/=]+)_crop_[^/]*\.json(/[^/]+)?$", 1)
    crop = F.from_json("value", "targetSize int, normalizedDeltas struct<x:double,y:double>")
    rows = files.select("path", F.split(key, "_crop_")[0].alias("image_id"), crop.alias("c")).filter("image_id <> '' and c.targetSize is not null")
    return rows.select("path", "image_id", F.col("c.targetSize").alias("target_size"), F.col("c.normalizedDeltas.x").alias("delta_x"), F.col("c.normalizedDeltas.y").alias("delta_y"))


def whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, value) of all files below, each as one text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("content").cast("string").alias("value"))


def write_packed(files: DataFrame, path: str) -> None:
    """Side files given as (path, value) kept as rows of one table. Stores make, list and open files one by one, which takes longer
    than all else where each holds a caption or a crop."""
    files.select("path", "value").write.parquet(path)


def side_files(spark: SparkSession, path: str | list[str], packed: bool = False) -> DataFrame:
    """(path, value) of the side files below a path, or of those that ``write_packed`` has put there."""
    return spark.read.schema("path string, value string").parquet(path) if packed else whole_files(spark, path)


def read_captions_txt(spark: SparkSession, path: str, known: DataFrame | None = None, packed: bool = False) -> DataFrame:
    """(image_id, caption) from <id>_caption.txt files; ids already known are left out."""
    rows = captions_of(side_files(spark, path, packed)).select("image_id", "caption")
    return rows if known is None else rows.join(known.select(F.col("image_id").cast("string").alias("image_id")), "image_id", "left_anti")


def read_crop_json(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(image_id, target_size, delta_x, delta_y) from <id>_crop_<size>.json files; the largest size of an id wins."""
    return largest_crop(crops_of(side_files(spark, path, packed)).drop("path"))


def largest_crop(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c != "image_id"]
    return rows.groupBy("image_id").agg(F.max_by(F.struct(*rest), F.struct(*rest)).alias("c")).select("image_id", *[f"c.{c}" for c in rest])


def write_by(rows: DataFrame, path: str, key: str) -> None:
    """One folder for each value of ``key``: those that ``rows`` has are replaced, all others stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_embeddings(rows: DataFrame, path: str) -> None:
    """(config_id, path, embedding): the configurations in ``rows`` are stored anew, others keep their vectors."""
    write_by(rows, path, "config_id")


def read_embeddings(spark: SparkSession, path: str, config_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("config_id") == config_id)


def write_features(rows: DataFrame, path: str) -> None:
    """Long feature vectors (image, method, v), padded within a method; other methods in the store stay as they are."""
    write_by(pad_by_method(rows), path, "method")


def read_features(spark: SparkSession, path: str, methods: list[str] | None = None) -> DataFrame:
    """(image, method, v) of the stored methods, or of those asked for; a method that is not stored gives no rows."""
    rows = spark.read.parquet(path).withColumn("method", F.col("method").cast("string"))
    return rows if methods is None else rows.filter(F.col("method").isin(*methods))
