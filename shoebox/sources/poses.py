"""Pose documents: nested JSON records of pictures, the people in them and other detections.

A document is a JSON array of records, one record, or lines of either. Records come in two layouts: flat ``landmarks`` (x, y,
within 0 to 1) with ``people``, or ``body_keypoints`` (x, y, confidence in 368-pixel space), whose key points may be flat or
in triples. What cannot be read as a record is handed back with the reason, and the rest is read all the same.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shoebox.operators.vectors import pose_features

BOX = "bounding_box struct<x1:double,y1:double,x2:double,y2:double>"
PERSON = f"struct<person_id:int,landmarks:array<double>,pose_confidence:double,detection_score:double,visibility_scores:array<double>,{BOX.replace(' ', ':', 1)},keypoint_format:string,class_name:string>"
DETECTION = f"struct<class_name:string,class_id:int,confidence:double,{BOX.replace(' ', ':', 1)}>"
RECORD = (
    "image_path string, has_pose boolean, person_count int, landmarks array<double>, pose_confidence double, visibility_scores array<double>, "
    f"people array<{PERSON}>, additional_detections array<{DETECTION}>, total_detections int, body_keypoints array<struct<keypoints:string>>"
)
#: Pictures below this confidence are left out; a missing confidence is 0.
LEAST_CONFIDENCE = 0.2


class Poses(NamedTuple):
    """``records``: one row a picture; ``rejects``: (source, value, reason)."""

    records: DataFrame
    rejects: DataFrame


def _numbers(text: Column) -> Column:
    """Flat numbers of a JSON array of numbers or of arrays of numbers."""
    nested = F.flatten(F.from_json(text, "array<array<double>>"))
    return F.when(text.rlike(r"^\s*\[\s*\["), nested).otherwise(F.from_json(text, "array<double>"))


def parse_poses(documents: DataFrame, value: str = "value", source: str = "path") -> Poses:
    """Records of documents given as rows of text.

    Adds layout (landmarks, keypoints or none), keypoints (flat x, y, confidence of the first person in the old layout) and
    features (the picture's pose vector, null without a pose) to the fields of a record."""
    text = F.col(value)
    listed = F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    # read where it is listed, so that no filter on what is read has it read again
    read = F.transform(listed, lambda x: F.struct(x.alias("item"), F.from_json(x, RECORD + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")))
    each = documents.select(F.col(source).alias("source"), text.alias("document"), F.explode_outer(read).alias("_x"))
    parsed = each.filter(F.col("document").rlike(r"\S")).select("source", "document", "_x.item", "_x.r")  # blank lines are no records
    reason = F.when(F.col("item").isNull(), "no JSON").when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), "no record").when(F.col("r.image_path").isNull(), "no image_path")
    told = parsed.withColumn("reason", reason)
    good = told.filter("reason is null").select("source", "r.*").drop("_corrupt")
    first = F.get("body_keypoints", F.lit(0))["keypoints"]
    good = good.withColumn("keypoints", _numbers(first)).drop("body_keypoints")
    layout = F.when(F.size("landmarks") > 0, "landmarks").when(F.size("keypoints") > 0, "keypoints").otherwise("none")
    records = good.withColumns({"layout": layout, "features": pose_features(F.col("landmarks"), F.col("keypoints"))})
    return Poses(records, told.filter("reason is not null").select("source", F.coalesce("item", "document").alias("value"), "reason"))


def read_poses(spark: SparkSession, path: str, lines: bool = False) -> Poses:
    """Pose documents below a path; with ``lines`` each line is a document, so that large files are read in parts."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=not lines)
    return parse_poses(rows.select(F.col("_metadata.file_path").alias("path"), "value"))


def confident(records: DataFrame, threshold: float = LEAST_CONFIDENCE) -> DataFrame:
    """Records whose pose confidence reaches the threshold; a missing one is 0."""
    return records.filter(F.coalesce("pose_confidence", F.lit(0.0)) >= threshold)


def people_of(records: DataFrame) -> DataFrame:
    """(image_path, position, the fields of a person): one row for each person, in the record's order from 0."""
    return records.select("image_path", F.posexplode("people").alias("position", "p")).select("image_path", "position", "p.*")


def detections_of(records: DataFrame) -> DataFrame:
    """(image_path, position, class_name, class_id, confidence, bounding_box) of everything else that was detected."""
    return records.select("image_path", F.posexplode("additional_detections").alias("position", "d")).select("image_path", "position", "d.*")


def joints_of(records: DataFrame) -> DataFrame:
    """(id, points): structs x, y, conf of each joint, in the space of 368 pixels, from either layout.

    Landmarks have the visibility scores as confidence, 1 where there are none."""
    triples = lambda v: F.transform(F.sequence(F.lit(0), (F.size(v) / 3).cast("int") - 1), lambda j: F.struct(F.get(v, j * 3).alias("x"), F.get(v, j * 3 + 1).alias("y"), F.get(v, j * 3 + 2).alias("conf")))
    seen = lambda j: F.coalesce(F.get("visibility_scores", j), F.lit(1.0))
    marks = F.transform(F.sequence(F.lit(0), (F.size("landmarks") / 2).cast("int") - 1), lambda j: F.struct((F.get("landmarks", j * 2) * 368).alias("x"), (F.get("landmarks", j * 2 + 1) * 368).alias("y"), seen(j).alias("conf")))
    points = F.when(F.size("landmarks") >= 2, marks).when(F.size("keypoints") >= 3, triples(F.col("keypoints")))
    return records.select(F.col("image_path").alias("id"), points.alias("points")).filter("points is not null")
