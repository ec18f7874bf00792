"""Hierarchies in ordinary tables as entries of trees (see rollup.build)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import model as M
from ..operators.rollup import entries

#: Base of the times that tables without one get: 2024-01-01 UTC.
EPOCH = 1704067200


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _leaf(df: DataFrame, path, content, mtime) -> DataFrame:
    return entries(df, path=path, hash=M.digest(content), mtime=mtime, own_bytes=F.octet_length(content))


def _doc(root: str):
    return F.concat_ws("/", F.lit(root), "source", "lang", F.concat(F.lit("doc"), F.col("doc_id")))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaf(read(spark, sf_dir, "documents"), _doc("root"), F.col("text"), EPOCH + F.col("doc_id"))


def docs_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(_doc("root").alias("path"), F.col("text").alias("content"))


def mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    part = d.where(F.col("source").isin("src0", "src1", "src2", "src3", "src4"))
    made = [_leaf(x, _doc(r), F.col("text"), EPOCH + F.col("doc_id")) for x, r in ((d, "root/orig"), (part, "root/copy"))]
    return made[0].unionByName(made[1])


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("doc_id % 17 != 0")
    edited, moved = F.col("doc_id") % 19 == 0, F.col("doc_id") % 23 == 0
    d1 = d.withColumn("text", F.when(edited, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("lang", F.when(moved & ~edited, F.lit("moved")).otherwise(F.col("lang")))
    more = read(spark, sf_dir, "documents").where("doc_id % 29 = 0").withColumn("doc_id", F.col("doc_id") + 1000000)
    return _leaf(d1.unionByName(more), _doc("root"), F.col("text"), EPOCH + F.col("doc_id"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    target = F.concat(F.lit("../docs/doc"), F.col("doc_id"))
    near = F.col("quality") == 1
    l = read(spark, sf_dir, "labels").join(d, "doc_id")
    linked = entries(l, path=F.concat(F.lit("root/links/l"), F.col("doc_id")), type=F.when(near, F.lit("L")).otherwise(F.lit("B")), hash=M.digest(F.when(near, F.col("text")).otherwise(target)), mtime=EPOCH + F.col("doc_id"), own_bytes=F.when(near, F.octet_length("text")).otherwise(F.octet_length(target)), link_target=target)
    return linked.unionByName(_leaf(d, F.concat(F.lit("root/docs/doc"), F.col("doc_id")), F.col("text"), EPOCH + F.col("doc_id")))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = F.element_at(F.split("path", "/doc"), -1).cast("long") % 97 == 0
    return docs(spark, sf_dir).withColumn("type", F.when(lost, F.lit("E")).otherwise(F.col("type"))).withColumn("err_msg", F.when(lost, F.lit("read failed")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.lit("root"), F.concat(F.lit("u"), F.col("user_id")), "event_type", F.concat(F.lit("e"), F.col("event_id")))
    return _leaf(read(spark, sf_dir, "events"), path, F.coalesce("props", F.lit("")), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000))


def commerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    # customers get their folders first: orders, of which there are more, move once, by a key of many values
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    folders = read(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws("/", F.lit("world"), "r_name", "n_name", "c_name").alias("folder"))
    o = read(spark, sf_dir, "orders").join(folders, F.col("o_custkey") == F.col("c_custkey"))
    path = F.concat_ws("/", "folder", F.concat(F.lit("o"), F.col("o_orderkey")))
    content = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    return _leaf(o, path, content, F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000000))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts reversed (com/example/blog), then the first path segment, then the page."""
    p = read(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    host = F.array_join(F.reverse(F.split(F.substring_index(bare, "/", 1), r"\.")), "/")
    segment = F.split(bare, "/").getItem(1)
    path = F.concat_ws("/", F.lit("web"), host, segment, F.concat(F.lit("p"), F.col("page_id")))
    return _leaf(p, path, F.col("html"), EPOCH + F.col("page_id"))
