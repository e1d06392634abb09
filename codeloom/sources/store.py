"""An index kept as numbered snapshots of Parquet tables, changed by merges and cascading deletes.

A write makes a whole new snapshot folder beside the old one and then moves one small pointer file, so readers see either
snapshot and a job that dies halfway changes nothing. The revision is the pointer's number. One writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Keys of the index's tables, and the columns by which a removed file takes rows along.
KEYS = {
    "symbols": ["id"], "refs": ["symbol_name", "referenced_in_file", "line", "column_num"], "imports": ["file_path", "imported_path", "imported_symbol"], "files": ["path"], "file_tags": ["file_path", "category", "tag"],
    "scopes": ["id"], "call_edges": ["caller_id", "symbol_name", "referenced_in_file", "line", "column_num"], "metrics": ["symbol_id"], "projects": ["manifest_path"], "dependencies": ["project_id", "name", "version"],
    "doc_digests": ["file_path"], "config_digests": ["file_path"], "profiles": ["project_path"], "nodes": ["id"], "entry_points": ["file_path", "line"], "file_meta": ["file_path"], "tag_dictionary": ["canonical_name"],
}
FILE_COLUMN = {"symbols": "file_path", "refs": "referenced_in_file", "imports": "file_path", "files": "path", "file_tags": "file_path", "call_edges": "referenced_in_file"}


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of `updates` replace those of `base` with the same key; of several updates the last by `order` counts.

    Keys with a null part never equal one another (as in a unique index) and are all kept.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    if order:
        w = Window.partitionBy(*keys).orderBy(F.desc(order), *[F.desc(c) for c in updates.columns if c not in keys and c != order])
        updates = updates.filter(~known).unionByName(updates.filter(known).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn"))
    else:
        updates = updates.filter(~known).unionByName(updates.filter(known).dropDuplicates(keys))
    return base.join(updates.filter(known).select(*keys), keys, "left_anti").select(*base.columns).unionByName(updates.select(*base.columns))


def delete_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the files (column path); references by the name of removed symbols stay, as
    another definition may bear it."""
    gone = paths.select("path").distinct()
    return {name: t.join(gone.withColumnRenamed("path", FILE_COLUMN[name]), FILE_COLUMN[name], "left_anti") if name in FILE_COLUMN else t for name, t in tables.items()}


SCHEMA_VERSION = 1


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self) -> dict:
        """The pointer of the highest number. Each commit writes one of its own, which appears whole by a rename, so there is
        no moment without a pointer."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))] if self._fs.exists(self._path(self.root)) else []
        numbers = [int(m[1]) for n in names if (m := re.fullmatch(r"current-(\d+)\.json", n))]
        if not numbers:
            return {"schema": SCHEMA_VERSION, "revision": 0, "tables": {}}
        found = json.loads(self.spark.read.text(f"{self.root}/current-{max(numbers)}.json", wholetext=True).first()[0])
        have = found.get("schema", 0)
        if have != SCHEMA_VERSION:
            what = "is newer than this engine's" if have > SCHEMA_VERSION else "must be migrated to"
            raise ValueError(f"the index has schema {have}, which {what} {SCHEMA_VERSION}")
        return found

    @property
    def revision(self) -> int:
        return self._pointer()["revision"]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._pointer()["tables"][name])

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.spark.read.parquet(p) for n, p in self._pointer()["tables"].items()}

    def commit(self, changed: dict[str, DataFrame], batch: str | None = None) -> int:
        """Writes the changed tables as a new revision; the others are carried over without a copy.

        batch: names what is written; a batch that was committed last is not committed again. Two writers that commit the
        same revision at once: the second one's rename fails, and nothing of it is seen.
        """
        now = self._pointer()
        if batch is not None and now.get("batch") == batch:
            return now["revision"]
        rev = now["revision"] + 1
        attempt = uuid.uuid4().hex[:8]
        for name, df in changed.items():
            out = f"{self.root}/r{rev}-{attempt}/{name}"
            df.write.mode("overwrite").parquet(out)
            now["tables"][name] = out
        now["revision"], now["batch"] = rev, batch
        tmp = self._path(f"{self.root}/.next-{rev}-{attempt}")
        stream = self._fs.create(tmp, True)
        stream.write(bytearray(json.dumps(now).encode()))
        stream.close()
        target = self._path(f"{self.root}/current-{rev}.json")
        if self._fs.exists(target) or not self._fs.rename(tmp, target):
            self._fs.delete(tmp, False)
            raise OSError(f"revision {rev} of {self.root} was written by another writer")
        return rev

    def clear(self) -> int:
        """An empty index as a new revision; every table keeps its columns."""
        return self.commit({n: t.limit(0) for n, t in self.tables().items()})

    def merge(self, updates: dict[str, DataFrame], removed: DataFrame | None = None, order: str | None = None, batch: str | None = None) -> int:
        """Removes the files (column path), then upserts the updates; nothing to do leaves the revision as it is."""
        old = self.tables()
        changed = delete_files(old, removed) if removed is not None else {}
        for name, u in updates.items():
            base = changed.get(name, old.get(name))
            changed[name] = upsert(base, u, KEYS[name], order) if base is not None else upsert(u.limit(0), u, KEYS[name], order)
        return self.commit(changed, batch) if changed else self.revision
