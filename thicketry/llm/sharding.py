"""Shards of bounded size by extendible hashing, with DataFrame operations only.

Every row has a string of hash bits. A bucket is a prefix of bits; the one bucket of depth 0 holds all rows, and a
bucket over the byte limit, and no other, splits on its next bit until every bucket fits. A shard is thus the
shortest prefix whose rows fit. Sizes of all prefixes come from one histogram over the first bits: enough bits
that most buckets fit (the directory's index); rows in buckets that are still too large go on to a next round with
more bits. No round reads rows of buckets that fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_BYTES = 1 << 20
#: Bits of a word of hash; a row has two: of its key, and of its place, which parts rows of equal keys.
WORD = 60
#: Bits that the directory's index has beyond what an even spread needs.
SPARE = 3


def _bits(hexadecimal: Column) -> Column:
    return F.lpad(F.conv(F.substring(hexadecimal, 1, WORD // 4), 16, 2), WORD, "0")


def shards(docs: DataFrame, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, shard (its bits, '' if all rows fit in one), depth, shard_bytes, shard_docs, oversized.

    n_bytes: UTF-8 bytes of the text, 0 for null. A row that alone exceeds the limit gets a shard of its own, marked
    oversized. Rows of equal (or null) ids have equal key bits, so their bucket goes on splitting on the second
    word, drawn from the row's place in the written key table: equal rows are interchangeable, none is lost. An
    empty table gives no rows. Other columns are ignored.
    """
    keyed = common.written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
            F.concat(_bits(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))), _bits(F.md5(F.monotonically_increasing_id().cast("string").cast("binary")))).alias("bits"),
        ),
        "shard-keys",
    )
    total = keyed.agg(F.sum("n_bytes")).first()[0] or 0
    fits = (F.col("shard_bytes") <= max_bytes) | (F.col("shard_docs") == 1)
    rows, low, out = keyed, 0, None
    high = min(WORD, max(0, math.ceil(math.log2(max(1, total / max_bytes)))) + SPARE)
    while True:
        index = rows.groupBy(F.substring("bits", 1, high).alias("entry")).agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
        index = common.written(index, "shard-index")
        ways = index.select("entry", "shard_bytes", "shard_docs", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        ways = ways.withColumn("shard", F.expr("substring(entry, 1, depth)"))
        sizes = ways.groupBy("shard", "depth").agg(F.sum("shard_bytes").alias("shard_bytes"), F.sum("shard_docs").alias("shard_docs"))
        small = sizes.where(fits)
        parents = small.select(F.col("shard").alias("above"))
        leaves = small.withColumn("above", F.expr(f"if(depth > {low}, substring(shard, 1, depth - 1), null)")).join(parents, "above", "left_anti").drop("above")
        directory = ways.select("entry", "shard").join(leaves, "shard").withColumn("oversized", F.col("shard_bytes") > max_bytes)
        placed = rows.withColumn("entry", F.substring("bits", 1, high)).join(directory, "entry").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs", "oversized")
        out = placed if out is None else out.unionByName(placed)
        stuck = index.where(~fits).select("entry")
        if high == 2 * WORD or not stuck.take(1):
            return out
        rows = rows.withColumn("entry", F.substring("bits", 1, high)).join(stuck, "entry", "left_semi").drop("entry")
        low, high = high + 1, min(2 * WORD, high + 12)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(common.table(spark, sf_dir, "documents"))


SQL = f"""
WITH keyed AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS bits
  FROM documents),
sizes AS (
  SELECT d.depth::INT AS depth, substr(bits, 1, d.depth::INT) AS shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs
  FROM keyed, range(0, 41) AS d(depth) GROUP BY 1, 2),
small AS (SELECT * FROM sizes WHERE shard_bytes <= {MAX_BYTES} OR shard_docs = 1)
SELECT k.doc_id, k.n_bytes, s.shard, s.depth, s.shard_bytes, s.shard_docs, s.shard_bytes > {MAX_BYTES} AS oversized
FROM keyed k JOIN small s ON s.shard = substr(k.bits, 1, s.depth)
QUALIFY row_number() OVER (PARTITION BY k.doc_id ORDER BY s.depth) = 1
"""
