"""Exact deduplication by content sort.

Sampled splitters (Spark's range exchange) deal the normalised texts out in content order,
the external sort puts equal texts next to each other, and the window compares each full text
with its neighbour. Texts with more copies than a partition should hold are split by a salt;
one representative text of each split is compared again, so that no task sees a whole hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.common import ascii_lower, materialize, shuffle_partitions

#: Splitters carry this much of the text and a hash of all of it, so that samples stay small.
SPLITTER_CHARS = 32


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", case_sensitive: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: "min" retains the smallest id of equal texts, "max" the largest.
    Null text equals the empty text. Rows that share an id and a text count each, and one of
    them is kept. Null ids never stay where the group has another id; a group of null ids alone
    keeps one row, with keep_id null. Very long texts are compared whole. An empty table gives no
    rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    norm = F.coalesce(text, F.lit("")) if case_sensitive else ascii_lower(text)
    keyed = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("h", F.xxhash64("norm"))

    # A group above the mean partition gets salts: there are at most as many of these as partitions.
    fair = max(1, -(-docs.count() // shuffle_partitions(spark)))
    hot = keyed.groupBy("h").count().where(F.col("count") > fair).select("h", F.ceil(F.col("count") / fair).cast("int").alias("salts"))
    dealt = (
        keyed.join(F.broadcast(hot), "h", "left")
        .withColumn("salts", F.coalesce("salts", F.lit(1)))
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
        .withColumn("head", F.substring("norm", 1, SPLITTER_CHARS))
        .repartitionByRange("head", "h", "salt")
    )
    best = F.col("id").asc_nulls_last() if keep == "min" else F.col("id").desc_nulls_last()
    run = Window.partitionBy("head", "h", "salt", "norm").orderBy(best)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = dealt.select(
        "id", "norm", "salts",
        F.row_number().over(run).alias("place"),
        F.first("id").over(whole).alias("run_keep"),
        F.count(F.lit(1)).over(whole).alias("run_size"),
    ).select(
        "id", "salts", "place", "run_keep", "run_size", F.sha2("norm", 256).alias("text_sha256"),
        F.when((F.col("salts") > 1) & (F.col("place") == 1), F.col("norm")).alias("shown"),
    )
    rows = materialize(rows, "exact-dedup")

    # The runs of a salted text meet by their whole text; each hot text gives one row.
    pick = F.min if keep == "min" else F.max
    merged = (
        rows.where(F.col("shown").isNotNull())
        .groupBy("shown").agg(pick("run_keep").alias("all_keep"), F.sum("run_size").alias("all_size"))
        .select(F.sha2("shown", 256).alias("text_sha256"), F.lit(True).alias("salted"), "all_keep", "all_size")
    )
    out = rows.withColumn("salted", F.col("salts") > 1).join(F.broadcast(merged), ["text_sha256", "salted"], "left")
    keep_id = F.when(F.col("salted") & F.col("all_size").isNotNull(), F.col("all_keep")).otherwise(F.col("run_keep"))
    return out.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        ((F.col("place") == 1) & F.col("id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )
