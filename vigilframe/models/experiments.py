"""A log of experiments: a row of settings and measures for each run, appended once."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: The file that Spark's committer writes last.
DONE = "_SUCCESS"


class ExperimentLog:
    """A folder that all executors share, with a table for each run.

    A run counts once its table is complete. Repeating it changes nothing; what a writer that died
    left behind is written anew. All runs have the columns of schema.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _folder(self, run: str) -> str:
        return f"{self.path}/run-{hashlib.sha256(run.encode()).hexdigest()}"

    def _complete(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{DONE}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def append(self, run: str, rows: DataFrame) -> bool:
        """Adds the rows of a run; false, and no change, if it is there already."""
        folder = self._folder(run)
        if self._complete(folder):
            return False
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.mode("overwrite").parquet(folder)
        return True

    def rows(self) -> DataFrame:
        """The rows of all complete runs."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run-*/{DONE}")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        folders = [f.getPath().getParent().toString() for f in found]
        try:
            return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.rows()  # a run was written anew meanwhile
