"""Vector columns: arithmetic, feature vectors, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit vector; null for a zero vector."""
    n = norm(v)
    return F.when(n > 0, divided(v, n))


def divided(v: Column, n: Column) -> Column:
    """A vector over a number; the number is an argument, not part of the function, which would take it anew for each component."""
    return F.zip_with(v, F.array_repeat(n, F.size(v)), lambda x, d: x.cast("double") / d)


def with_unit_vectors(rows: DataFrame, vector: str = "v") -> DataFrame:
    """Rows with unit vectors; zero and null vectors are left out."""
    return rows.withColumn("_n", norm(F.col(vector))).filter("_n > 0").withColumn(vector, divided(F.col(vector), F.col("_n"))).drop("_n")


def mean_vector(rows: DataFrame, vector: str = "v") -> DataFrame:
    """One row: the mean by position of all vectors of one width."""
    parts = rows.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias(vector))


def target_embedding(rows: DataFrame, targets: DataFrame, id_: str = "id") -> DataFrame:
    """One row: the normalised mean of the targets' unit vectors; no row, if no target exists."""
    found = with_unit_vectors(rows.join(targets.select(id_), id_, "left_semi"))
    return mean_vector(found).select(l2_normalize(F.col("v")).alias("v")).filter("v is not null")


def pose_features(landmarks: Column, legacy: Column, size: float = 368.0) -> Column:
    """Flat landmarks, else the legacy key points' x and y over ``size``; null without either."""
    xy = F.transform(F.filter(legacy, lambda x, i: i % 3 < 2), lambda x: x / size)
    return F.when(F.size(landmarks) > 0, landmarks).when(F.size(legacy) > 0, xy)


def feature_vector(method: str, **fields: Column) -> Column:
    """A method's vector from its record's fields, in fixed order."""
    if method == "canny":
        full = F.concat(fields["spatial"], fields["orientation"], fields["magnitude"], fields["statistics"])
        short = F.concat(F.array(fields["density"], fields["mean_magnitude"]), fields["orientation"])
        return F.when(F.size(fields["spatial"]) > 0, full).otherwise(short)
    if method == "harris":
        return F.concat(F.array(fields["count"], fields["strength"]), fields["grid"])
    if method in ("glcm", "orb"):
        return F.array(*fields.values())
    return next(iter(fields.values()))


def pad_by_method(rows: DataFrame) -> DataFrame:
    """Vectors of each method, padded with zeros to the method's longest; rows without a vector are left out."""
    own = rows.filter("v is not null")
    longest = own.groupBy("method").agg(F.max(F.size("v")).alias("width"))
    return own.join(F.broadcast(longest), "method").withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.col("width") - F.size("v")))).drop("width")


def combined(left: DataFrame, right: DataFrame, weight_left: float, weight_right: float, id_: str = "id") -> DataFrame:
    """Inner join on the id: unit vectors of both sides, weighted and set side by side."""
    a = with_unit_vectors(left).select(id_, F.col("v").alias("a"))
    b = with_unit_vectors(right).select(id_, F.col("v").alias("b"))
    v = F.concat(F.transform("a", lambda x: x * weight_left), F.transform("b", lambda x: x * weight_right))
    return a.join(b, id_).select(id_, v.alias("v"))


def zscore(rows: DataFrame, wide: int = 80) -> DataFrame:
    """Vectors of ``wide`` or more: per dimension (x - mean) / (population deviation + 1e-8) over all rows; else unit rows."""
    width = rows.agg(F.max(F.size("v")).alias("w"))
    first = width.first()["w"]
    if first is None or first < wide:
        return with_unit_vectors(rows)
    parts = rows.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = parts.agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("stats"))
    return rows.join(F.broadcast(stats)).withColumn("v", F.zip_with("v", "stats", lambda x, s: (x - s["m"]) / (s["s"] + 1e-8))).drop("stats")


def pose_similarity(a: Column, b: Column, method: str = "euclidean") -> Column:
    """Similarity of two key-point lists (x, y, conf structs) over joints seen in both; 0 without any."""
    both = F.filter(F.zip_with(a, b, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda z: (z["p"]["conf"] > 0) & (z["q"]["conf"] > 0))
    add = lambda f: F.aggregate(both, F.lit(0.0), lambda s, z: s + f(z["p"], z["q"]))
    if method == "euclidean":
        value = 1 / (1 + F.sqrt(add(lambda p, q: F.pow((p["x"] - q["x"]) / 368, 2) + F.pow((p["y"] - q["y"]) / 368, 2))))
    else:
        d = add(lambda p, q: p["x"] * q["x"] + p["y"] * q["y"])
        n = F.sqrt(add(lambda p, q: p["x"] * p["x"] + p["y"] * p["y"])) * F.sqrt(add(lambda p, q: q["x"] * q["x"] + q["y"] * q["y"]))
        value = F.when(n > 0, (d / n + 1) / 2).otherwise(0.0)
    return F.when(F.size(both) > 0, value).otherwise(0.0)
