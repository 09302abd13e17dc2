"""Features of each user carried over micro-batches as keyed state.

What a window over the stored table would look back at is state here: the user's last time, the
times of the trailing minute and the counts so far. Rows of one micro-batch are put in order; a
row that comes in a later batch than one of a later time is taken as it comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "row_id long, user_id string, time_since_last_access double, actions_per_minute long, success_count long, failure_count long"
STATE = "last long, recent array<long>, success long, failure long"


def carried(micros: np.ndarray, last: int | None, recent: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gaps in seconds, rows of the trailing window, what stays of it) for times in order that follow `recent`."""
    before = np.r_[micros[0] if last is None else last, micros[:-1]]
    every = np.r_[recent, micros]
    # Windows are open on the left; rows up to the row itself count.
    counts = np.arange(len(recent) + 1, len(every) + 1) - np.searchsorted(every, micros - width, side="right")
    return (micros - before) / 1e6, counts, every[every > every[-1] - width]


def user_features(events: DataFrame, minute: float = 60.0) -> DataFrame:
    """A streaming frame of canonical events with row_id to a row of OUT for each event.

    Success and failure counts are those up to the event. Events without a time have a gap and a
    window of 0 and leave no state but their counts. A user's rows of one micro-batch are one
    group, so the batch bounds it.
    """
    width = round(minute * 1e6)

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, recent, success, failure = state.get if state.exists else (None, [], 0, 0)
        # A group is a few rows and there are many: arrays, as each call of pandas costs more than the rows.
        found = [(p["row_id"].to_numpy(), p["known"].to_numpy(bool), p["micros"].to_numpy(), p["good"].to_numpy(), p["bad"].to_numpy()) for p in parts]
        row_id, known, micros, good, bad = found[0] if len(found) == 1 else (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((row_id, micros, known))
        row_id, known, micros, good, bad = row_id[order], known[order], micros[order], good[order].cumsum(), bad[order].cumsum()
        gaps, counts = np.zeros(len(row_id)), np.zeros(len(row_id), np.int64)
        if known.any():
            gaps[known], counts[known], left = carried(micros[known], last, np.array(recent, np.int64), width)
            last, recent = int(micros[-1]), left.tolist()
        yield pd.DataFrame({"row_id": row_id, "user_id": key[0], "time_since_last_access": gaps, "actions_per_minute": counts, "success_count": success + good, "failure_count": failure + bad})
        state.update((last, recent, success + int(good[-1]), failure + int(bad[-1])))

    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    is_ = lambda s: F.coalesce(F.col("status") == s, F.lit(False)).cast("long")
    rows = events.select("row_id", "user_id", micros.isNotNull().alias("known"), F.coalesce(micros, F.lit(0)).alias("micros"), is_("success").alias("good"), is_("failure").alias("bad"))
    return rows.groupBy("user_id").applyInPandasWithState(work, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
