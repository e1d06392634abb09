"""Parquet tables, the valid version of a row, and checkpoints that survive executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """One row per non-null key: the one with the greatest `at`.

    Rows without `at` are older than any other. Rows that tie are compared by the remaining columns in the order
    given, so the result doesn't depend on the order of rows. Runs as a partial and a final aggregation: copies of a
    hot key are reduced before the shuffle. Columns must be orderable (no maps).
    """
    rest = [c for c in columns if c not in (key, at)]
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(F.struct(at, *rest)).alias("_v"))
        .select(key, *[F.col(f"_v.{c}").alias(c) for c in columns if c != key])
    )


def clean_path(path: Column) -> Column:
    """Backslashes become slashes, doubled slashes one, a leading './' goes; case stays."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/{2,}", "/")
    return F.regexp_replace(p, r"^(?:\./)+", "")


def micros(ts: Column) -> Column:
    """Timestamp (with or without zone) as epoch microseconds."""
    return F.unix_micros(ts.cast("timestamp"))


_written: list = []  # (hadoop file system, path) of what this process has written and may delete at its end


def _delete_written() -> None:
    for fs, path in _written:
        try:
            fs.delete(path, True)
        except Exception:  # noqa: BLE001  the session may be gone; whoever owns the folder clears it
            return


atexit.register(_delete_written)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share, deleted when this process ends.

    The folder is spark.checkpoint.dir. Only a local session without one (tests) gets a folder of its machine; on a cluster
    intermediate tables would be lost there, so it is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base is None and (d := sc._jsc.sc().getCheckpointDir()).isDefined():
        base = d.get()
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "codeloom-checkpoints")
    out = f"{base}/codeloom-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(out)
    _written.append((path.getFileSystem(sc._jsc.hadoopConfiguration()), path))
    return out


def materialise(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it back: a compressed checkpoint.

    The files outlive the loss of any executor; the plan behind them is cut off.
    """
    out = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)
