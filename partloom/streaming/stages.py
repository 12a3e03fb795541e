"""Streams: progress that never goes back, event windows, deduplication, and page carry as custom state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Events with a watermark; a time without zone is read as the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def sliding_counts(events: DataFrame, width: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    return timed(events).groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return timed(events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def first_events(events: DataFrame) -> DataFrame:
    return timed(events).dropDuplicatesWithinWatermark(["event_id"])


def furthest_stage(progress: DataFrame) -> DataFrame:
    """(job, stage): the furthest stage each job has reported; a late report of an earlier one changes nothing."""
    return progress.groupBy("job").agg(F.max("stage").alias("stage"))


def continued_records(rows: DataFrame) -> DataFrame:
    """(key, record, text) of closed records from rows (key, seq, starts, text) that arrive in order.

    A record stays open, in state, over batches until the next one starts.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, text = state.get if state.exists else (0, "")
        out = []
        for pdf in batches:
            for r in pdf.sort_values("seq").itertuples():
                if r.starts:
                    if number:
                        out.append((key[0], number, text))
                    number, text = number + 1, r.text
                elif number:
                    text = f"{text} {r.text}"
        state.update((number, text))
        yield pd.DataFrame(out, columns=["key", "record", "text"])

    return rows.groupBy("key").applyInPandasWithState(step, "key string, record long, text string", "record long, text string", "append", GroupStateTimeout.NoTimeout)
