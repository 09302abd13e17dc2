"""Event files: CSV as the rule engine reads it, CSV and Parquet sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.schema import EVENT

LABELLED = EVENT | {"role": "string", "is_anomaly": "boolean", "row_id": "bigint"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header line and the columns of a labelled event in any order; times that don't parse are null."""
    header = spark.read.option("header", True).csv(path).columns
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in header)).option("header", True).csv(path)
    return raw.select(*[F.col(f"`{c}`").try_cast(LABELLED.get(c, "string")).alias(c) for c in header])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_scored(scored: DataFrame, path: str) -> None:
    """Events with is_anomaly_predicted, anomaly_score and, where there are labels, is_anomaly_true."""
    out = scored.withColumnRenamed("is_anomaly", "is_anomaly_true") if "is_anomaly" in scored.columns else scored
    flat = [c for c, kind in out.dtypes if not kind.startswith(("array", "struct", "map", "vector", "udt"))]
    write_csv(out.select(*flat), path)
