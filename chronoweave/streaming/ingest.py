"""Streams of episodes: idempotent micro-batch ingest and debounced work per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Seconds of idleness, pending episodes that fire at once, batch size, passes until a batch is dropped, longest delay.
IDLE, TRIGGER, CAP, FAILURES, LONGEST = 8, 5, 32, 4, 900


def retry_delay(failed: int, first: int = 2 * IDLE) -> int:
    """Seconds until the next try: doubling from 16 s, at most a quarter of an hour."""
    return min(first * 2 ** max(0, failed - 1), LONGEST)


class Debounce(StatefulProcessor):
    """Per group: waits until it was idle, or ``trigger`` episodes are pending, then emits them in batches of ``cap``."""

    def __init__(self, idle_ms: int = IDLE * 1000, trigger: int = TRIGGER, cap: int = CAP):
        self.idle_ms, self.trigger, self.cap = idle_ms, trigger, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "uuid string")

    def _fire(self, key: tuple) -> Iterator[pd.DataFrame]:
        ids = sorted({row[0] for row in self.pending.get()})
        self.pending.clear()
        for i in range(0, len(ids), self.cap):
            part = ids[i : i + self.cap]
            yield pd.DataFrame({"group_id": [key[0]], "n_episodes": [len(part)], "episodes": [",".join(part)]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.pending.appendList([(u,) for u in pdf["uuid"]])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if len(list(self.pending.get())) >= self.trigger:
            yield from self._fire(key)
        else:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._fire(key)

    def close(self) -> None:
        pass


def debounced(stream: DataFrame, idle_ms: int = IDLE * 1000, trigger: int = TRIGGER) -> DataFrame:
    """``group_id, n_episodes, episodes`` of the batches due, from a stream of ``group_id, uuid``."""
    return stream.select("group_id", "uuid").groupBy("group_id").transformWithStateInPandas(Debounce(idle_ms, trigger), "group_id string, n_episodes long, episodes string", "Update", "processingTime")


def episode_stream(spark: SparkSession, folder: str, schema: StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def ingest_once(target: str, key: str = "uuid") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that adds each key once: a batch that is run again, and keys seen before, add nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(target).where(~F.input_file_name().contains(f"/batch={batch_id}/")).select(key), key, "left_anti")
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write
