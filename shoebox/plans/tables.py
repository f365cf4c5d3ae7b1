"""Logical tables of a picture collection derived from the given tables, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from shoebox.operators import vectors as V


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def photosets(self) -> DataFrame:
        o = self.read("orders")
        return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("set_"), F.col("o_orderkey")).alias("name"), F.to_date("o_orderdate").alias("date"), F.year("o_orderdate").alias("year"))

    @cached_property
    def lines(self) -> DataFrame:
        return self.read("lineitem").withColumn("image_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))

    @cached_property
    def images(self) -> DataFrame:
        g = self.lines.groupBy("l_orderkey", "l_linenumber").agg(F.floor(F.min("l_extendedprice")).alias("file_size"), (400 + F.max("l_quantity") * 60).cast("int").alias("width"))
        file = F.concat(F.col("l_linenumber"), F.lit(".jpg"))
        return g.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("photoset_id"), F.concat_ws("/", "l_orderkey", file).alias("file_path"),
            file.alias("filename"), "file_size", "width", (300 + F.col("l_linenumber") * 250).alias("height"),
        )

    @cached_property
    def tag_rows(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_type").alias("tag_type"))

    @cached_property
    def image_tags(self) -> DataFrame:
        return self.lines.join(self.read("part"), F.col("l_partkey") == F.col("p_partkey")).select("image_id", F.col("p_name").alias("name")).distinct()

    @cached_property
    def docs(self) -> DataFrame:
        d = self.read("documents")
        return d.select(F.col("doc_id").alias("id"), F.col("source").alias("scene"), F.col("lang").alias("tag"), F.concat(F.col("doc_id"), F.lit(".png")).alias("file_path"))

    @cached_property
    def captions(self) -> DataFrame:
        return self.read("documents").filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("image_id"), F.col("text").alias("caption"))

    @cached_property
    def crops(self) -> DataFrame:
        return self.read("labels").select(F.col("doc_id").alias("image_id"), F.concat(F.lit("crops/"), F.col("doc_id"), F.lit(".jpg")).alias("crop_file_path"), F.col("quality"))

    @cached_property
    def emb(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")

    @cached_property
    def sep(self) -> DataFrame:
        up = F.transform("v", lambda x, i: x + F.when(i == F.col("label"), 2.0).otherwise(0.0))
        return V.with_unit_vectors(self.emb.withColumn("v", up))

    @cached_property
    def labels(self) -> DataFrame:
        """Two experiments: the given labels, and vec_id % 7 with every fifth as noise."""
        e = self.emb
        one = e.select(F.lit("a").alias("experiment_id"), F.col("id").alias("image"), F.col("label").cast("int").alias("cluster_id"))
        two = e.select(F.lit("b").alias("experiment_id"), F.col("id").alias("image"), F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("id") % 7).cast("int").alias("cluster_id"))
        return one.unionByName(two)

    @cached_property
    def points(self) -> DataFrame:
        def point(j):
            at = lambda o: F.get(F.col("v"), j * 3 + o)
            return F.struct((at(0) * 368).alias("x"), (at(1) * 368).alias("y"), F.greatest(at(2), F.lit(0.0)).alias("conf"))

        return self.emb.filter("id % 4 <> 0").select("id", F.transform(F.sequence(F.lit(0), F.lit(16)), point).alias("points"))

    @cached_property
    def poses(self) -> DataFrame:
        g = self.lines.groupBy("image_id").agg(F.round(F.max("l_discount") * 10, 6).alias("pose_confidence"), F.count("*").alias("person_count"), F.count_if(F.col("l_returnflag") == "R").alias("total_detections"))
        return g.withColumn("has_pose", F.col("image_id") % 5 != 0)


#: The same tables in SQL, each by name.
SQL = {
    "photosets": "select o_orderkey id, 'set_' || o_orderkey as name, cast(o_orderdate as date) as date, cast(year(o_orderdate) as int) as year from orders",
    "images": "select l_orderkey*10+l_linenumber id, l_orderkey photoset_id, l_orderkey || '/' || l_linenumber || '.jpg' file_path, l_linenumber || '.jpg' filename, cast(floor(min(l_extendedprice)) as bigint) file_size, cast(400+max(l_quantity)*60 as int) width, 300+l_linenumber*250 height from lineitem group by l_orderkey, l_linenumber",
    "tag_rows": "select p_partkey ord, p_name as name, p_type tag_type from part",
    "tags": "select name, arg_min(tag_type, ord) tag_type from (select p_partkey ord, p_name as name, p_type tag_type from part) group by name",
    "image_tags": "select distinct l_orderkey*10+l_linenumber image_id, p_name as name from lineitem join part on l_partkey = p_partkey",
    "docs": "select doc_id id, source scene, lang tag, doc_id || '.png' file_path from documents",
    "captions": "select doc_id image_id, text caption from documents where doc_id % 3 <> 0",
    "crops": "select doc_id image_id, 'crops/' || doc_id || '.jpg' crop_file_path, quality from labels",
    "emb": "select vec_id id, cast(embedding as double[]) v, label from embeddings",
    "sep": "select id, label, list_transform(u, lambda x: x / sqrt(list_sum(list_transform(u, lambda y: y * y)))) v from (select vec_id id, label, list_transform(cast(embedding as double[]), lambda x, i: x + case when i = label + 1 then 2.0 else 0.0 end) u from embeddings)",
    "labs": "select 'a' experiment_id, vec_id image, cast(label as int) cluster_id from embeddings union all select 'b', vec_id, cast(case when vec_id % 5 = 0 then -1 else vec_id % 7 end as int) from embeddings",
    "points": "select id, list_transform(range(0, 17), lambda j: struct_pack(x := v[j*3+1]*368, y := v[j*3+2]*368, conf := greatest(v[j*3+3], 0.0))) points from (select vec_id id, cast(embedding as double[]) v from embeddings) where id % 4 <> 0",
    "poses": "select l_orderkey*10+l_linenumber image_id, round(max(l_discount)*10, 6) pose_confidence, count(*) person_count, count(*) filter (l_returnflag = 'R') total_detections, (l_orderkey*10+l_linenumber) % 5 <> 0 has_pose from lineitem group by 1, 5",
}


def sql(names: str, body: str) -> str:
    """``body`` with the named tables as common table expressions."""
    if not names:
        return body
    own = ", ".join(f"{n} as ({SQL[n]})" for n in names.split())
    return f"with {own}, {body[5:]}" if body.startswith("with ") else f"with {own} {body}"
