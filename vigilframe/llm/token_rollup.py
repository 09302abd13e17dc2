"""Token counts by source, language and tokenizer version, maintained by signed deltas.

Every batch of changes is reduced to signed totals per group and written as an attempt of its
own; a commit record, one for each batch id, names the attempt that counts. Records are written
whole under another name and then given their own, which only the first writer gets. So a commit
that is repeated after a failure, or by a second writer, changes nothing, and one that dies
before its record has its name never was. fold() adds what was committed since to the maintained
totals: a new snapshot, which counts once a pointer names it. Totals are the last snapshot and
the deltas that came after it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Mapping
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from vigilframe.llm.packing import _Encoder

#: Batches after which their deltas are folded into the totals.
FOLD_EVERY = 200
GROUP = ["source", "lang", "tokenizer", "version"]
DELTA = "source string, lang string, tokenizer string, version string, documents long, tokens long"


def token_count(text: Column, tokenizer_path: str) -> Column:
    """Ids of the text by a tokenizer file, without special tokens; null and empty texts have none."""
    from vigilframe.llm.packing import AT_ONCE, encoder

    def sizes(ids: _Encoder, texts: pa.Array) -> Iterator[int]:
        # A batch stays in Arrow memory; only a slice of it is Python strings at a time.
        for at in range(0, len(texts), AT_ONCE):
            yield from (len(x) // 4 for x in ids.encode([t or "" for t in texts.slice(at, AT_ONCE).to_pylist()]))

    @F.arrow_udf("long")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = encoder(tokenizer_path)
        for texts in batches:
            yield pa.array(sizes(ids, texts), pa.int64(), size=len(texts))

    return counts(text)


def counted(docs: DataFrame, counters: Mapping[tuple[str, str], Column], source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(source, lang, tokenizer, version, tokens): a row per document and counter; null counts are 0."""
    each = F.array(*[
        F.struct(F.lit(name).alias("tokenizer"), F.lit(version).alias("version"), F.coalesce(c, F.lit(0)).cast("long").alias("tokens"))
        for (name, version), c in counters.items()
    ])
    return docs.select(F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.explode(each).alias("x")).select("source", "lang", "x.*")


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(*GROUP, F.lit(1).cast("long").alias("documents"), F.col("tokens").cast("long").alias("tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*GROUP, F.lit(-1).cast("long").alias("documents"), (-F.col("tokens")).cast("long").alias("tokens"))


def revisions(rows: DataFrame) -> DataFrame:
    """rows: GROUP, old_tokens, new_tokens. The documents stay, their counts change."""
    return rows.select(*GROUP, F.lit(0).cast("long").alias("documents"), (F.coalesce("new_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))).cast("long").alias("tokens"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class TokenRollup:
    """A rollup kept in a folder that all executors share.

    Null sources and languages are groups of their own; null and empty texts count as documents
    without tokens; very long texts are counted whole and repeated rows each. Groups that come to
    zero documents and zero tokens are not reported. An empty batch is recorded, an empty rollup
    has no rows. Any text but the empty one is a batch id. The folder's file system must refuse
    to rename a file to a name that is taken, as HDFS does; local folders are linked instead.
    After fold_every batches a commit folds, so that totals read a bounded number of deltas.
    """

    def __init__(self, spark: SparkSession, path: str, fold_every: int = FOLD_EVERY) -> None:
        self.spark, self.path, self.fold_every = spark, path.rstrip("/"), fold_every

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds a batch once; false, and no change, if its id was committed before, here or by another writer."""
        if not batch_id:
            raise ValueError("a batch needs an id")
        record = f"commits/b{hashlib.sha256(batch_id.encode()).hexdigest()}.json"
        if self._exists(record):
            return False
        attempt = uuid.uuid4().hex
        _summed(deltas).write.parquet(f"{self.path}/deltas/attempt={attempt}")
        done = self._create(record, {"batch": batch_id, "attempt": attempt})
        if done and self._unfolded(self._snapshot()[1]).limit(self.fold_every).count() == self.fold_every:
            self.fold()
        return done

    def fold(self) -> bool:
        """Adds the batches committed since to the maintained totals; false if there are none or another writer was first."""
        number, snapshot = self._snapshot()
        new = self._unfolded(snapshot)
        if new.isEmpty():
            return False
        name = uuid.uuid4().hex
        # Written from one reading of the records each: what is summed is what is listed as folded.
        new.write.parquet(f"{self.path}/folded/{name}-new")
        new = self.spark.read.schema("attempt string").parquet(f"{self.path}/folded/{name}-new")
        _summed(self._totals_of(snapshot).unionByName(self._deltas(new))).where("documents <> 0 or tokens <> 0").write.parquet(f"{self.path}/snapshots/{name}")
        self._folded(snapshot).unionByName(new).write.parquet(f"{self.path}/folded/{name}")
        return self._create(f"pointers/p{number + 1:012d}.json", {"number": number + 1, "snapshot": name})

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, version, documents, tokens)."""
        _, snapshot = self._snapshot()
        return _summed(self._totals_of(snapshot).unionByName(self._deltas(self._unfolded(snapshot)))).where("documents <> 0 or tokens <> 0")

    def _path(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        system, path = self._path(name)
        return system.exists(path)

    def _create(self, name: str, content: Mapping) -> bool:
        """Makes a small file whole, or not at all if there is one of that name; the first writer wins."""
        system, path = self._path(name)
        _, draft = self._path(f"drafts/{uuid.uuid4().hex}.json")
        out = system.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        system.mkdirs(path.getParent())
        try:
            return self._publish(system, draft, path)
        finally:
            system.delete(draft, False)

    def _publish(self, system, draft, path) -> bool:  # noqa: ANN001
        """Gives the draft its name, unless that is taken."""
        if system.getScheme() != "file":
            return system.rename(draft, path)
        # A local rename would replace the other file; a link doesn't.
        files, local = self.spark._jvm.java.nio.file.Files, lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            files.createLink(local(path), local(draft))
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def _records(self, folder: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).json(f"{self.path}/{folder}").where(f"{schema.split()[0]} is not null")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # nothing written yet

    def _snapshot(self) -> tuple[int, str | None]:
        last = self._records("pointers", "number long, snapshot string").orderBy(F.desc("number")).first()
        return (last["number"], last["snapshot"]) if last else (0, None)

    def _totals_of(self, snapshot: str | None) -> DataFrame:
        return self.spark.read.schema(DELTA).parquet(f"{self.path}/snapshots/{snapshot}") if snapshot else self.spark.createDataFrame([], DELTA)

    def _folded(self, snapshot: str | None) -> DataFrame:
        return self.spark.read.schema("attempt string").parquet(f"{self.path}/folded/{snapshot}") if snapshot else self.spark.createDataFrame([], "attempt string")

    def _unfolded(self, snapshot: str | None) -> DataFrame:
        return self._records("commits", "batch string, attempt string").select("attempt").join(self._folded(snapshot), "attempt", "left_anti")

    def _deltas(self, attempts: DataFrame) -> DataFrame:
        """The signed totals of the given attempts."""
        names = [r["attempt"] for r in attempts.collect()]  # fewer than fold_every, save those of writers at the same time
        if not names:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*[f"{self.path}/deltas/attempt={n}" for n in names])
