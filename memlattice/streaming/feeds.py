"""Streaming forms: event statistics, a running journal state and progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.functions.keys import bounded
from memlattice.operators import journal as J
from memlattice.operators.replay import replay
from memlattice.session import materialize


def stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 16) -> DataFrame:
    """A file stream with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per tumbling window; events later than ``late`` behind the newest are left out.

    An addition: the reference has no event-time windows. Partial counts combine before the shuffle.
    """
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_to_table(df: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there into a table under ``path`` and reads it: of mode ``complete`` the
    last batch, else all of them. A batch that is tried again replaces itself."""
    done: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        done.append(number)

    q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    read = df.sparkSession.read.schema(df.schema)
    if not done:
        return df.sparkSession.createDataFrame([], df.schema)
    return read.parquet(f"{path}/data/batch={max(done)}" if mode == "complete" else f"{path}/data").select(df.columns)


def progress_states(ticks: DataFrame) -> DataFrame:
    """Per session a row whenever it advances: (session, current, total, percent, done), state kept per session.

    Late or repeated ticks (a smaller current) change nothing.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else 0
        total, moved = (state.get[1] if state.exists else 0), False
        for b in batches:
            top = int(b["current"].max())
            total = max(total, int(b["total"].max()))
            if top > best:
                best, moved = top, True
        state.update((best, total))
        if moved:
            pct = min(100.0, 100.0 * best / total) if total > 0 else 0.0
            yield pd.DataFrame({"session": [key[0]], "current": [best], "total": [total], "percent": [pct], "done": [total > 0 and best >= total]})

    return ticks.groupBy("session").applyInPandasWithState(advance, "session string, current long, total long, percent double, done boolean", "current long, total long", "update", GroupStateTimeout.NoTimeout)


class JournalApplier:
    """Applies micro-batches of remote changes to a journal table, each change once.

    A batch goes to its own folder named by its number, so a batch that is tried again
    replaces itself; what the journal has already is left out.
    """

    def __init__(self, spark: SparkSession, path: str, on_batch: Callable[[DataFrame, int], None] | None = None):
        self.spark, self.path, self.on_batch = spark, path, on_batch

    def journal(self, before: int | None = None) -> DataFrame | None:
        try:
            j = self.spark.read.parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return None
        return j if before is None else j.where(F.col("batch") < before)

    def apply(self, batch: DataFrame, number: int) -> None:
        rows = J.tidied(batch)
        old = self.journal(number)
        if old is not None:  # only what it has of the batch's entities
            keys = materialize(rows.select("entity_type", "entity_id").distinct(), "touched")
            old = old.drop("batch").join(bounded(keys, keys.count()), ["entity_type", "entity_id"], "left_semi").select(rows.columns)
        fresh = J.applied(old, rows) if old is not None else J.applied(rows.limit(0), rows)
        fresh.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        if self.on_batch:
            self.on_batch(fresh, number)

    def start(self, changes: DataFrame, checkpoint: str):
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def state(self) -> DataFrame | None:
        """The live entities of what has been applied."""
        j = self.journal()
        return None if j is None else replay(j)
