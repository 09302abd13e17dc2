"""Readers by name. Every reader takes (spark, path) and returns canonical events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigilframe.sources.cloud import read_activity, read_trail
from vigilframe.sources.synthetic import Generator, read_synthetic


def read_privileged(spark: SparkSession, path: str | None = None, n: int = 10_000, **generator) -> DataFrame:
    """Synthetic privileged access without labels."""
    return Generator(**generator).privileged(spark, n).drop("is_anomaly")


READERS: dict[str, Callable[..., DataFrame]] = {"aws": read_trail, "azure": read_activity, "synthetic": read_synthetic, "cyberark": read_privileged}


def get_log_reader(source: str) -> Callable[..., DataFrame]:
    """The reader of a source, by name in any case."""
    try:
        return READERS[source.lower()]
    except KeyError:
        raise ValueError(f"no reader for {source!r}; there are {', '.join(READERS)}") from None


def read(spark: SparkSession, source: str, path: str | None = None, **options) -> DataFrame:
    return get_log_reader(source)(spark, path, **options)
