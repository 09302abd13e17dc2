"""The corpus pipeline: stages over documents, each calling one of the text operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet to the shared folder and gives it to the next stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm import quality
from vigilframe.llm.common import discard, held_out, materialize, table
from vigilframe.llm.line_dedup import line_dedup, passages_of
from vigilframe.llm.mixing import mixed_documents
from vigilframe.llm.packing import pack_documents
from vigilframe.llm.queries import tokenizer_path
from vigilframe.llm.simhash import near_duplicates

#: Documents below this probability of good quality are rejected.
QUALITY = 0.3
#: Rows that go to a Python worker at once: long texts must fit beside what workers keep from earlier stages.
ROWS_AT_ONCE = 1000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)


def _may_learn(doc_id: Column) -> Column:
    return ~held_out(doc_id, 0)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    _small_batches(spark)
    model = quality.fit(spark, docs, table(spark, sf_dir, "labels"), learn_from=_may_learn)
    return quality.score(docs, model, score_col="__quality").where(F.col("__quality") >= QUALITY).drop("__quality")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of lines, or long lines, that occurred before."""
    return line_dedup(docs, min_lines=1, pieces=passages_of)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word shingles, the one with the smallest id."""
    _small_batches(spark)
    return near_duplicates(docs, shingle=5, budget=3, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 ids."""
    _small_batches(spark)
    return pack_documents(docs, tokenizer_path(), window=1024, end_id=0, emit={"ids_crc32": F.crc32("ids")})


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mix", mix),
    ("pack", pack),
]

#: The classifier and the tokenizer have no SQL form; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline_query() -> dict:
    return {"pipeline": run}


def pipeline_oracle() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
