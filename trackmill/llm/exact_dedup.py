"""Exact duplicates by sorting contents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored

#: A text found in more than one in HOT_SHARE of the rows is dealt out over SALTS parts; at most HOT_SHARE texts are.
HOT_SHARE, SALTS = 500, 64
#: Characters of a text that splitters are made of.
START = 64


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def content_sort(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Spark samples splitters of the normalised texts' first START characters (and, where those are equal, of a hash),
    range-partitions the rows by them and sorts each range by the whole text (spilling to disk), so that equal texts are
    neighbours; a window over the sorted rows compares each text in full with the one before it. The smallest doc_id of
    a run stays. Splitters of whole texts would bring long texts to the driver.

    A text with very many copies would fill one range. Texts are therefore counted by a hash first, and a text with
    over 1/HOT_SHARE of the rows is also ranged by a salt, of the row and not of its id, which may be null or repeated. Each salted run leaves one head, at most HOT_SHARE * SALTS in
    all, and the heads' full texts are compared in a second, small round. The hash only decides who is salted: texts
    are always compared whole.

    Where START characters tie, ranges are of the hash, not of the rest of the text; neighbours are whole texts all the
    same. Null text is an empty one; a very long one is sorted whole. Null doc_ids sort last and are kept only if a group has no other. If a doc_id is
    repeated within a group, one of its rows is kept. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), normalised(F.col(f"`{text}`")).alias("norm"))
    rows = rows.withColumn("h", F.xxhash64("norm"))
    counts = stored(rows.groupBy("h").count(), "copies")
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = [r.h for r in counts.where(F.col("count") > max(1, total // HOT_SHARE)).select("h").collect()]  # < HOT_SHARE
    salted = F.col("h").isin(hot) if hot else F.lit(False)
    rows = rows.withColumn("hot", salted)
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))).otherwise(0))

    rows = rows.withColumn("start", F.substring("norm", 1, START))
    run = Window.partitionBy("start", "h", "norm", "salt")
    order = run.orderBy(F.col("doc_id").asc_nulls_last())
    runs = rows.repartitionByRange("start", "h", "salt").select(
        "doc_id", "h", "hot", "salt",
        F.row_number().over(order).alias("place"),
        F.first("doc_id").over(order).alias("first_id"),
        F.count("*").over(run).alias("n"),
        F.sha2("norm", 256).alias("text_sha256"),
        F.when(F.col("hot") & (F.row_number().over(order) == 1), F.col("norm")).alias("head"),
    )
    runs = stored(runs, "runs")

    rank = F.struct(F.col("first_id").isNull(), "first_id", "salt")
    heads = runs.where("head IS NOT NULL")
    whole = heads.groupBy("head").agg(
        F.min(rank)["first_id"].alias("keep_id"), F.min(rank)["salt"].alias("keep_salt"), F.sum("n").alias("total")
    )
    whole = heads.join(whole, "head").select("h", "salt", "first_id", "keep_id", "keep_salt", "total")
    whole = F.broadcast(whole.select("keep_id", "keep_salt", "total", *[F.col(c).alias(f"w_{c}") for c in ("h", "salt", "first_id")]))
    same = (F.col("h") == F.col("w_h")) & (F.col("salt") == F.col("w_salt")) & F.col("first_id").eqNullSafe(F.col("w_first_id"))
    cold = F.col("total").isNull()
    return runs.join(whole, same & F.col("hot"), "left").select(
        "doc_id",
        F.when(cold, F.col("first_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("total", "n").alias("group_size"),
        ((F.col("place") == 1) & (cold | (F.col("salt") == F.col("keep_salt")))).alias("kept"),
        "text_sha256",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents."""
    return content_sort(read(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
