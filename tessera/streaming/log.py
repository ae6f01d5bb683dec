"""The result log as a stream: append-only, a batch is one epoch of a durable log, an id counts once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..plans import registry
from ..sources import epochs
from ..sources.records import accepted, checked, rejected


def read_log(spark: SparkSession, path: str, schema: T.StructType = registry.RESULT) -> DataFrame:
    """Parsable lines of a growing log folder, as a stream."""
    return accepted(checked(read_lines(spark, path), schema), schema)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a growing log folder with the file of each, as a stream."""
    return spark.readStream.schema("value string").format("text").load(path).select("value", F.col("_metadata.file_path").alias("file"))


def split_sink(good: str, bad: str, schema: T.StructType) -> Callable[[DataFrame, int], None]:
    """A sink for :func:`read_lines`: rows go to one durable log, malformed lines with their file to another."""

    def write(batch: DataFrame, number: int) -> None:
        held = checked(batch, schema).persist()
        try:
            epochs.commit(rejected(held), bad, number)
            epochs.commit(accepted(held, schema), good, number)
        finally:
            held.unpersist()

    return write


def once(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Each id once; the ids seen are the stream's state, kept in its checkpoint."""
    return rows.where(F.nullif(F.col(id_col), F.lit("")).isNotNull()).dropDuplicates([id_col])


def run_to_end(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a later call goes on from the checkpoint."""
    query = rows.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def restored(spark: SparkSession, checkpoint: str, *fields: str) -> DataFrame:
    """Keys that a stateful stream holds, read from its checkpoint by the state data source."""
    held = spark.read.format("statestore").load(checkpoint)
    return held.select(*[F.col(f"key.{f}").alias(f) for f in fields])


_PROGRESS = "id string, iterations int, satisfied boolean, sft_case string"


class _Question(StatefulProcessor):
    """Attempts and verdict of one question, its responses, and a timer that ends it where no attempt follows."""

    def __init__(self, max_iterations: int, patience_ms: int) -> None:
        self.most, self.patience = max_iterations, patience_ms

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.seen = handle.getValueState("seen", "iterations int, satisfied boolean")
        self.verdicts = handle.getListState("verdicts", "iteration int, satisfied boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: ANN001, N802, N803
        rows = initialState.sort_values("iteration")
        self._take(rows)

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        for part in rows:
            n, done = self._take(part.sort_values("iteration"))
        if self.patience:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not done and n < self.most:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield self._row(key, n, done, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        n, done = self.seen.get()
        yield self._row(key, n, done, True)

    def close(self) -> None:
        pass

    def _take(self, rows: pd.DataFrame) -> tuple[int, bool]:
        n, done = self.seen.get() if self.seen.exists() else (0, False)
        for i, ok in zip(rows["iteration"], rows["satisfied"], strict=True):
            if not done and n < self.most:
                n, done = n + 1, bool(ok)
                self.verdicts.appendValue((int(i), bool(ok)))
        self.seen.update((n, done))
        return n, done

    def _row(self, key, n: int, done: bool, stalled: bool) -> pd.DataFrame:  # noqa: ANN001
        case = (registry.CASE_A if n == 1 else registry.CASE_B) if done else registry.SKIPPED if stalled else registry.CASE_C if n >= self.most else None
        return pd.DataFrame({"id": [str(key[0])], "iterations": [n], "satisfied": [done], "sft_case": [case]})


def progress(iterations: DataFrame, max_iterations: int = 5, log: DataFrame | None = None, patience_ms: int = 0) -> DataFrame:
    """Running state of each question from a stream of (id, iteration, satisfied).

    ``log`` has iterations from before the stream, with which its state begins. A
    question that waits longer than ``patience_ms`` for its next attempt is given
    out as skipped; such a stream has to be stopped, since it waits for its timers.
    Needs the RocksDB state store (:func:`needs_rocksdb`).
    """
    start = None if log is None else log.select("id", "iteration", "satisfied").groupBy("id")
    return iterations.groupBy("id").transformWithStateInPandas(_Question(max_iterations, patience_ms), _PROGRESS, "Update", "ProcessingTime" if patience_ms else "None", start)


def needs_rocksdb(spark: SparkSession) -> None:
    """Choose the state store that keeps several values a key."""
    # Fixed value: the class of that store.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
