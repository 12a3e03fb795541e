"""Edits of documents held back until they pause, in state with timers, and written by one writer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.versions import Versions

#: Milliseconds without an edit after which a document is written.
GAP_MS = 600
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debounce(StatefulProcessor):
    """The last edit of each key and the number of edits, given out once no edit has come for `gap` milliseconds.

    Every edit moves the key's one timer.  What is held lives in the state store, so
    an executor that is lost, or a query that is started again, loses no edit.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "seq long, document string, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, document, n = self.held.get() if self.held.exists() else (None, None, 0)
        for pdf in rows:
            last = pdf.sort_values("seq", kind="stable").iloc[-1]
            n += len(pdf)
            if seq is None or last["seq"] >= seq:
                seq, document = int(last["seq"]), last["document"]
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gap)
        self.held.update((seq, document, n))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return
        _, document, n = self.held.get()
        self.held.clear()
        # plain objects: the serializer of this call takes no Arrow-backed strings
        yield pd.DataFrame({"key": pd.Series([key[0]], dtype=object), "document": pd.Series([document], dtype=object), "n": [n]})

    def close(self) -> None:
        pass


def debounced(edits: DataFrame, gap: int = GAP_MS) -> DataFrame:
    """(key, document, n) of a stream of edits (key, seq, document): the newest document of each key once its edits pause.

    Of equal `seq` the later row counts; rows of a null key are left out.
    """
    edits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return edits.where("key IS NOT NULL").groupBy("key").transformWithStateInPandas(Debounce(gap), "key string, document string, n long", "Append", "ProcessingTime")


def write_pauses(edits: DataFrame, held: Versions, fields: str, now: Column, checkpoint: str, gap: int = GAP_MS, trigger: str = "200 milliseconds") -> StreamingQuery:
    """Start the one writer of a table: documents (JSON of `fields`) are merged in after each pause, a version for each batch that has any.

    Batches follow one another, so writes do too.  A batch that is run again merges
    the same documents again, which changes nothing but the stamp.
    """

    def write(batch: DataFrame, _id: int) -> None:
        told = batch.select(F.from_json("document", fields).alias("d")).select("d.*")
        held.upsert(told, now)

    return debounced(edits, gap).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
