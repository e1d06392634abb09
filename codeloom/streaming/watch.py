"""Streams: watched files and versioned documents, as Structured Streaming.

`debounced` collapses bursts per key by session windows behind a watermark; `accepted` keeps the greatest version per
document in state and marks late ones; `apply_changes` writes micro-batches into the snapshot store, each as one
revision, so a batch that is run again after a failure gives the same snapshot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloom.sources.store import SnapshotStore
from codeloom.sources.tables import scratch


def events_stream(spark: SparkSession, path: str, max_files: int = 256) -> DataFrame:
    """New Parquet files of a folder (or one file) as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", max_files)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(path.rsplit("/", 1)[0])
    return reader.parquet(path)


def debounced(events: DataFrame, key: str, ts: str, gap: str = "500 milliseconds", late: str = "1 day") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(key, F.session_window(F.col(ts), gap)).agg(F.count("*").alias("events"), F.max("event_id").alias("last_event")).select(key, "events", "last_event")


def accepted(updates: DataFrame, key: str, version: str) -> DataFrame:
    """(key, version, accepted) for each update: a version counts only if it is above all before it."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else None
        for f in frames:
            f = f.sort_values("arrival")
            good = []
            for v in f[version]:
                good.append(top is None or v > top)
                top = v if good[-1] else top
            yield pd.DataFrame({key: [k[0]] * len(f), version: f[version].to_numpy(), "accepted": good})
        if top is not None:
            state.update((int(top),))

    return updates.groupBy(key).applyInPandasWithState(step, f"{key} long, {version} long, accepted boolean", "top long", "append", GroupStateTimeout.NoTimeout)


def apply_changes(changes: DataFrame, store: SnapshotStore, extract, checkpoint: str, once: bool = True):
    """Change events (path, deleted, body) become merges: changed files are removed and what `extract` finds in their
    bodies is put in. Of several events of a file in a batch the last counts."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("path").agg(F.max(F.struct("at", "deleted", "body")).alias("v")).select("path", "v.deleted", "v.body")
        store.merge(extract(last.filter("not deleted and body is not null")), last.select("path"), batch=f"{checkpoint}#{number}")

    q = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()


class Progress(StreamingQueryListener):
    """Counts batches and rows of all streams of a session; percent and remaining time against a known total."""

    def __init__(self, total: int | None = None):
        self.total, self.rows, self.batches, self.seconds, self.failed = total, 0, 0, 0.0, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows
        self.batches += 1
        self.seconds += event.progress.batchDuration / 1000

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.failed += event.exception is not None

    def state(self) -> dict:
        done = None if not self.total else round(100 * min(1, self.rows / self.total), 1)
        left = None if not self.total or not self.rows else round(self.seconds / self.rows * max(0, self.total - self.rows), 1)
        return {"rows": self.rows, "batches": self.batches, "percent": done, "eta_seconds": left, "failed": self.failed}


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there into Parquet files of the shared folder, and reads them: in complete mode those
    of the last batch, else those of all. A batch that is run again overwrites its own files only."""
    out = scratch(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", scratch(stream.sparkSession)).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    d = stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(out)
    if mode == "complete":
        d = d.filter(F.col("batch") == d.agg(F.max("batch")).first()[0])
    return d.drop("batch")


def _debounce_stream(s: SparkSession, d: str) -> DataFrame:
    return run_to_table(debounced(events_stream(s, f"{d}/events.parquet"), "user_id", "ts", "10 minutes"), "complete")


QUERIES = {"stream_watch_debounce": _debounce_stream}
ORACLES = {
    "stream_watch_debounce": "WITH g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 600000000 THEN 0 ELSE 1 END AS n FROM events)) SELECT user_id, count(*) AS events, max(event_id) AS last_event FROM g GROUP BY user_id, k"
}
