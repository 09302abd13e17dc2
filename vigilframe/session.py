"""A session with the settings that the library counts on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def session(app_name: str = "vigilframe", master: str | None = None, **settings: str) -> SparkSession:
    """UTC and adaptive execution; anything else as the cluster or `settings` say."""
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master) if master else builder
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | settings
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local master may go without that setting; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='vigilframe-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, tag: str, compression: str = "zstd", by: Sequence[str] = ()) -> DataFrame:
    """Writes df to the shared folder, in folders by some columns, and reads it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/vigilframe/{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what materialize wrote, once nothing reads it any more. What a result still reads stays."""
    for df in tables:
        jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(hadoop).delete(path, True)
