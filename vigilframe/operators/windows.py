"""Windows over ordered events.

A trailing time window is open on the left, (t - w, t], and a row sees rows up to itself: later
rows of the same time are left out, ties being ordered by row_id.

Keys with very many rows are cut into slices; hot says which, or they are counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vigilframe.operators.slices import Build, Hot, apart, hot_keys, rows_window, running_sums

MICROS = "__micros"


def by(key: str, ts: str = "timestamp", row: str = "row_id") -> WindowSpec:
    return Window.partitionBy(key).orderBy(ts, row)


def _trailing(key: str, seconds: float) -> WindowSpec:
    return Window.partitionBy(key).orderBy(MICROS).rangeBetween(-(round(seconds * 1e6) - 1), 0)


def with_micros(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumn(MICROS, F.unix_micros(F.col(ts).cast("timestamp")))


def trailing_count(df: DataFrame, out: str, key: str, seconds: float, ts: str = "timestamp", row: str = "row_id", hot: Hot | None = None) -> DataFrame:
    """Rows of the key in the trailing window; 0 without a time."""

    def work(df: DataFrame, by_slices: bool) -> DataFrame:
        df = with_micros(df, ts)
        at = F.col(MICROS)
        if by_slices:
            return _open(df, {out: (at.isNotNull(), at.isNotNull())}, key, round(seconds * 1e6), row, True)
        peers = Window.partitionBy(key, MICROS)
        later = F.count(F.lit(1)).over(peers) - F.row_number().over(peers.orderBy(row))
        count = F.count(F.lit(1)).over(_trailing(key, seconds)) - later
        return df.withColumn(out, F.when(at.isNull(), 0).otherwise(count).cast("long")).drop(MICROS)

    return apart(df, hot or hot_keys(df, key), work)


def _open(df: DataFrame, changes: dict[str, tuple[Column, Column]], key: str, width: int, row: str, by_slices: bool, without: Sequence[str] = ()) -> DataFrame:
    """df, which has MICROS, with the running sum of what enters at a row and leaves `width` after one.

    changes: by new column, whether a row enters and whether it leaves. What leaves at a row's
    time is gone before the row; rows of one time follow each other. Columns in `without` go.
    """
    at, names, given = F.col(MICROS), list(changes), [c for c in df.columns if c not in (key, row, MICROS, *changes, *without)]
    df = df.withColumns({f"__in{i}": changes[n][0].cast("long") for i, n in enumerate(names)} | {f"__out{i}": changes[n][1] for i, n in enumerate(names)})
    step = lambda when, last, change: F.struct(when.alias("t"), F.lit(last).alias("last"), *[c.cast("long").alias(f"d{i}") for i, c in enumerate(change)])
    enters = step(at, True, [F.col(f"__in{i}") for i in range(len(names))])
    leaves = [F.when(F.col(f"__out{i}"), step(at + width, False, [F.lit(-1 if k == i else 0) for k in range(len(names))])) for i in range(len(names))]
    # What leaves carries no row along.
    df = df.select(key, row, MICROS, F.struct(*given).alias("__given"), F.explode(F.filter(F.array(enters, *leaves), lambda x: x.isNotNull())).alias("__step"))
    last = F.col("__step.last")
    df = df.select(key, F.when(last, F.col(row)).alias(row), MICROS, F.when(last, F.col("__given")).alias("__given"), F.col("__step.t").alias("__t"), last.alias("__last"), *[F.col(f"__step.d{i}").alias(f"__d{i}") for i in range(len(names))])
    df = running_sums(df, [key], ["__t", "__last", row], {n: f"__d{i}" for i, n in enumerate(names)}, by_slices)
    return df.where("__last").select(key, row, "__given.*", *[F.when(at.isNull(), 0).otherwise(F.col(n)).cast("long").alias(n) for n in names])


def trailing_distinct(df: DataFrame, out: dict[str, str], key: str, seconds: float, ts: str = "timestamp", row: str = "row_id", hot: Hot | None = None) -> DataFrame:
    """Distinct values in the trailing window for each {new column: column}; 0 without a time.

    A value is open from a sighting until the window's length after it. Where it wasn't open yet
    it enters, where no later sighting keeps it open it leaves, and a row's count is the running
    sum of both: no row gathers the rows of its window.
    """
    width, at = round(seconds * 1e6), F.col(MICROS)

    def work(df: DataFrame, by_slices: bool) -> DataFrame:
        df, changes = with_micros(df, ts), {}
        for i, (name, column) in enumerate(out.items()):
            beside = lambda w, i=i: {f"__before{i}": F.lag(MICROS).over(w), f"__after{i}": F.lead(MICROS).over(w)}
            df = rows_window(df, [key, column], [MICROS, row], beside, 1, 1, by_slices)
            before, after, seen = F.col(f"__before{i}"), F.col(f"__after{i}"), at.isNotNull() & F.col(column).isNotNull()
            changes[name] = (seen & (before.isNull() | (before <= at - width)), seen & (after.isNull() | (after >= at + width)))
        return _open(df, changes, key, width, row, by_slices, [f"__{side}{i}" for side in ("before", "after") for i in range(len(out))])

    return apart(df, hot or hot_keys(df, key), work)


def with_gap(df: DataFrame, out: str, key: str, ts: str = "timestamp", row: str = "row_id", hot: Hot | None = None) -> DataFrame:
    """Seconds since the key's previous row; 0 for the first."""
    gap = lambda w: {out: F.coalesce(F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts)) / 1e6, F.lit(0.0))}
    return apart(df, hot or hot_keys(df, key), lambda d, s: rows_window(d, [key], [ts, row], gap, back=1, by_slices=s))


def with_recent(df: DataFrame, key: str, rows: int, build: Build, ts: str = "timestamp", row: str = "row_id", hot: Hot | None = None) -> DataFrame:
    """Columns over the key's last `rows` rows, the row itself included."""
    frame = lambda w: build(w.rowsBetween(-(rows - 1), 0))
    return apart(df, hot or hot_keys(df, key), lambda d, s: rows_window(d, [key], [ts, row], frame, back=rows - 1, by_slices=s))


def with_next(df: DataFrame, out: str, key: str, column: str, ts: str = "timestamp", row: str = "row_id", hot: Hot | None = None) -> DataFrame:
    """The column's value in the key's next row; null for the last."""
    return apart(df, hot or hot_keys(df, key), lambda d, s: rows_window(d, [key], [ts, row], lambda w: {out: F.lead(column).over(w)}, forward=1, by_slices=s))


def running_distinct(df: DataFrame, out: str, key: str, column: str, ts: str = "timestamp", row: str = "row_id", hot: Hot | None = None) -> DataFrame:
    """Distinct non-null values of the key so far: first sightings, summed."""

    def work(df: DataFrame, by_slices: bool) -> DataFrame:
        df = rows_window(df, [key, column], [ts, row], lambda w: {"__seen": F.lag(row).over(w)}, back=1, by_slices=by_slices)
        df = df.withColumn("__new", (F.col("__seen").isNull() & F.col(column).isNotNull()).cast("long"))
        return running_sums(df, [key], [ts, row], {out: "__new"}, by_slices).drop("__new", "__seen")

    return apart(df, hot or hot_keys(df, key), work)


def sequences(df: DataFrame, features: Sequence[str] | Column, length: int = 10, key: str | None = "user_id", ts: str = "timestamp", row: str = "row_id", hot: Hot | None = None) -> DataFrame:
    """df with `sequence`: the feature rows of the last `length` events, null where there are fewer.

    features: columns, or an array of them. By key, or with key=None over the global order of all rows, which is cut into slices.
    """
    rows = features if isinstance(features, Column) else F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    build = lambda w: {"sequence": F.collect_list(rows).over(w.rowsBetween(-(length - 1), 0))}
    if key is None:
        out = rows_window(df, [], [ts, row], build, back=length - 1, by_slices=True)
    else:
        out = apart(df, hot or hot_keys(df, key), lambda d, s: rows_window(d, [key], [ts, row], build, back=length - 1, by_slices=s))
    return out.withColumn("sequence", F.when(F.size("sequence") == length, F.col("sequence")))
