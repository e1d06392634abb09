"""Incremental indexing: what changed between two states, merges, deletes, overlays, debouncing and sessions.

The file table keeps every time a path was indexed, so the state at a moment is an aggregation, and two moments give
the tracked and the current files. Comparisons are one full join by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.plans.index import BSYM_CTE, IMPORTS_CTE, REFS_CTE, SYM, TAGS_CTE, bound_symbols, file_tags, imports, refs, symbols
from codeloom.sources.store import KEYS, delete_files, upsert
from codeloom.sources.tables import table

# Letters of a version control's short status.
STATUS = {"A": "added", "?": "added", "M": "modified", "T": "modified", "D": "deleted", "R": "renamed", "C": "added"}


def state_at(files: DataFrame, moment: str) -> DataFrame:
    """(path, content_hash, last_size, last_mtime_ns) of the paths that existed at the moment, by their latest row."""
    t = F.to_timestamp(F.lit(moment)).cast(files.schema["indexed_at"].dataType)
    live = files.filter((F.col("indexed_at") <= t) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > t)))
    return live.groupBy("path").agg(F.max(F.struct("indexed_at", "last_mtime_ns", "last_size", "content_hash")).alias("v")).select("path", "v.content_hash", "v.last_size", "v.last_mtime_ns")


def precheck(current: DataFrame, tracked: DataFrame) -> DataFrame:
    """(path, status): unchanged by size and time, refreshed by hash only, changed, new, or stale."""
    t = tracked.select("path", F.col("content_hash").alias("h"), F.col("last_size").alias("s"), F.col("last_mtime_ns").alias("m"), F.lit(True).alias("t"))
    j = current.withColumn("c", F.lit(True)).join(t, "path", "full")
    same = (F.col("s") == F.col("last_size")) & (F.col("m") == F.col("last_mtime_ns"))
    return j.select("path", F.when(F.col("c").isNull(), "stale").when(F.col("t").isNull(), "new").when(same, "unchanged").when(F.col("h") == F.col("content_hash"), "metadata_refresh").otherwise("changed").alias("status"))


def overlay_accept(updates: DataFrame, key: str, version: str) -> DataFrame:
    """Versioned updates in order of arrival: each is accepted if its version is above all before it."""
    w = Window.partitionBy(key).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(version).over(w)
    return updates.withColumn("accepted", top.isNull() | (F.col(version) > top))


def debounce(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Bursts of events per key become one, the last."""
    return events.groupBy(key, F.session_window(F.col(ts), gap).alias("w")).agg(F.count("*").alias("events"), F.max(F.struct(ts, "event_id", "event_type")).alias("l")).select(key, F.col("events"), F.col("l.event_id").alias("last_event"), F.col("l.event_type").alias("event_type"))


def sessions(events: DataFrame, key: str, ts: str, ttl_seconds: int) -> DataFrame:
    """(key, session, events, seconds): a session ends when nothing came for longer than the time to live."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    d = events.select(key, "event_id", ts, t.alias("t")).withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(w) > ttl_seconds * 1_000_000).cast("int"), F.lit(1)))
    d = d.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return d.groupBy(key, "session").agg(F.count("*").alias("events"), F.floor((F.max("t") - F.min("t")) / 1_000_000).cast("long").alias("seconds"))


def changed_symbols(changes: DataFrame, df: DataFrame) -> DataFrame:
    """Symbols of changed files that still exist; a path may be given as it is, with './' or below a root folder; for each
    file the first of these forms that the index knows counts."""
    forms = F.array(F.struct(F.lit(0).alias("o"), F.col("path").alias("file_path")), F.struct(F.lit(1).alias("o"), F.regexp_replace("path", r"^\./", "").alias("file_path")), F.struct(F.lit(2).alias("o"), F.regexp_replace("path", r"^root/", "").alias("file_path")))
    c = changes.filter("status <> 'deleted'").select("path", "status", F.explode(forms).alias("f")).select("path", "status", "f.o", "f.file_path")
    known = c.join(df.select("file_path").distinct(), "file_path", "left_semi")
    first = known.groupBy("path", "status").agg(F.min_by("file_path", "o").alias("file_path"))
    return first.join(df, "file_path")


def hunk_lines(diff: DataFrame, key: str, header: str) -> DataFrame:
    """(key, line): new-side lines of hunk headers '@@ -a,b +c,d @@'; d is 1 where it's missing, and 0 gives none."""
    start = F.regexp_extract(header, r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).try_cast("int")
    n = F.regexp_extract(header, r"^@@ -\d+(?:,\d+)? \+\d+,(\d+)", 1)
    count = F.when(n == "", 1).otherwise(F.expr("try_cast(n as int)"))
    d = diff.withColumn("n", n).select(key, start.alias("s"), count.alias("c")).filter("s is not null and c > 0")
    return d.select(key, F.explode(F.expr("sequence(s, s + c - 1)")).alias("line"))


def status_name(letter: Column) -> Column:
    out = F.lit("modified")
    for k, v in STATUS.items():
        out = F.when(F.upper(F.substring(F.trim(letter), 1, 1)) == k, v).otherwise(out)
    return out


T0, T1, T2 = "2025-06-01 00:00:00", "2025-12-01 00:00:00", "2026-05-01 00:00:00"


def _pre(s, d, now: str = T2, before: str = T1):
    f = table(s, d, "files")
    return precheck(state_at(f, now), state_at(f, before))


def _merge(s, d):
    """The first state of each symbol as the base, and all later ones as updates."""
    t = table(s, d, "symbols").select("id", "name", "file_path", "indexed_at")
    w = Window.partitionBy("id").orderBy("indexed_at", "file_path", "name")
    r = t.withColumn("rn", F.row_number().over(w))
    return upsert(r.filter("rn = 1").drop("rn"), r.filter("rn > 1").drop("rn"), KEYS["symbols"], "indexed_at")


def _cascade(s, d):
    gone = bound_symbols(s, d).filter(F.col("file_path").like("%brand_1_/m1.rs")).select(F.col("file_path").alias("path"))
    t = delete_files({"symbols": bound_symbols(s, d), "refs": refs(s, d), "imports": imports(s, d), "file_tags": file_tags(s, d)}, gone)
    out = None
    for name, df in t.items():
        c = df.agg(F.count("*").alias("left")).select(F.lit(name).alias("name"), "left")
        out = c if out is None else out.unionByName(c)
    return out


def _overlay(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("arrival"), (F.col("event_id") * 7919 % 1000).alias("version"))
    return overlay_accept(e, "doc", "version")


def _changes(s, d):
    """All files of the index as a version control would name them."""
    p = symbols(s, d, ["file_path"]).distinct()
    n = F.length("file_path") % 5
    return p.select(F.when(n == 0, F.concat(F.lit("./"), "file_path")).when(n == 1, F.concat(F.lit("root/"), "file_path")).otherwise(F.col("file_path")).alias("path"), F.when(n == 2, "deleted").when(n == 3, "renamed").otherwise("modified").alias("status"))


def _hunks(s, d):
    return table(s, d, "orders").select("o_orderkey", F.expr("concat('@@ -1,', o_orderkey % 5, ' +', o_custkey % 90 + 1, case when o_orderkey % 4 = 0 then '' else concat(',', o_orderkey % 7) end, ' @@ fn')").alias("header"))


_ST = "(SELECT path, content_hash, last_size, last_mtime_ns FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, last_mtime_ns DESC NULLS LAST, last_size DESC NULLS LAST, content_hash DESC NULLS LAST) AS rn FROM files WHERE indexed_at <= TIMESTAMP '{t}' AND (deleted_at IS NULL OR deleted_at > TIMESTAMP '{t}')) WHERE rn = 1)"
_PRES = lambda now, before: f"WITH c AS {_ST.format(t=now)}, t AS {_ST.format(t=before)}, p AS (SELECT coalesce(c.path, t.path) AS path, CASE WHEN c.path IS NULL THEN 'stale' WHEN t.path IS NULL THEN 'new' WHEN t.last_size = c.last_size AND t.last_mtime_ns = c.last_mtime_ns THEN 'unchanged' WHEN t.content_hash = c.content_hash THEN 'metadata_refresh' ELSE 'changed' END AS status FROM c FULL JOIN t ON c.path = t.path) "
_PRE = _PRES(T2, T1)
_CH = f"WITH {SYM}, pa AS (SELECT DISTINCT file_path, length(file_path) % 5 AS n FROM sym), ch AS (SELECT * FROM (SELECT file_path, CASE n WHEN 0 THEN concat('./', file_path) WHEN 1 THEN concat('root/', file_path) ELSE file_path END AS path, CASE n WHEN 2 THEN 'deleted' WHEN 3 THEN 'renamed' ELSE 'modified' END AS status FROM pa) WHERE status <> 'deleted') "
QUERIES = {
    "precheck_status": _pre,
    "precheck_summary": lambda s, d: _pre(s, d).groupBy("status").agg(F.count("*").alias("files")),
    "stale_files": lambda s, d: _pre(s, d, T1, T0).filter("status = 'stale'").select("path"),
    "merge_upsert": lambda s, d: _merge(s, d).select("id", "name", "indexed_at"),
    "cascade_delete": _cascade,
    "overlay_versions": lambda s, d: _overlay(s, d).groupBy("doc").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("conflicts"), F.max("version").cast("long").alias("version")),
    "watch_debounce": lambda s, d: debounce(table(s, d, "events"), "user_id", "ts", "10 minutes"),
    "sessions_ttl": lambda s, d: sessions(table(s, d, "events"), "user_id", "ts", 3600),
    "git_changed_symbols": lambda s, d: changed_symbols(_changes(s, d), symbols(s, d, ["id", "name", "file_path"])).select("path", "status", "id"),
    "git_hunk_lines": lambda s, d: hunk_lines(_hunks(s, d), "o_orderkey", "header"),
    "git_status_decode": lambda s, d: table(s, d, "orders").select("o_orderkey", status_name(F.element_at(F.array(*[F.lit(x) for x in ("M ", " D", "??", "R100", "A", "!!")]), (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("status")),
}
ORACLES = {
    "precheck_status": _PRE + "SELECT * FROM p",
    "precheck_summary": _PRE + "SELECT status, count(*) AS files FROM p GROUP BY 1",
    "stale_files": _PRES(T1, T0) + "SELECT path FROM p WHERE status = 'stale'",
    "merge_upsert": "SELECT id, name, indexed_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, name DESC, file_path DESC) AS rn FROM symbols WHERE id IS NOT NULL) WHERE rn = 1",
    "cascade_delete": f"WITH {REFS_CTE}, {IMPORTS_CTE}, {TAGS_CTE}, gone AS (SELECT DISTINCT file_path AS p FROM bsym WHERE file_path LIKE '%brand_1_/m1.rs') SELECT 'symbols' AS name, count(*) AS left FROM bsym WHERE file_path NOT IN (SELECT p FROM gone) UNION ALL SELECT 'refs', count(*) FROM refs WHERE referenced_in_file NOT IN (SELECT p FROM gone) UNION ALL SELECT 'imports', count(*) FROM imports WHERE file_path NOT IN (SELECT p FROM gone) UNION ALL SELECT 'file_tags', count(*) FROM file_tags WHERE file_path NOT IN (SELECT p FROM gone)",
    "overlay_versions": "SELECT doc, count(*) FILTER (a) AS accepted, count(*) FILTER (NOT a) AS conflicts, max(version) AS version FROM (SELECT doc, version, coalesce(version > max(version) OVER (PARTITION BY doc ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS a FROM (SELECT user_id AS doc, event_id AS arrival, event_id * 7919 % 1000 AS version FROM events)) GROUP BY 1",
    "watch_debounce": "WITH g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 600000000 THEN 0 ELSE 1 END AS n FROM events)) SELECT user_id, count(*) AS events, arg_max(event_id, (ts, event_id)) AS last_event, arg_max(event_type, (ts, event_id)) AS event_type FROM g GROUP BY user_id, k",
    "sessions_ttl": "WITH g AS (SELECT *, (sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3600000000 THEN 0 ELSE 1 END AS n FROM events)) SELECT user_id, session, count(*) AS events, ((max(epoch_us(ts)) - min(epoch_us(ts))) // 1000000)::BIGINT AS seconds FROM g GROUP BY 1, 2",
    "git_changed_symbols": _CH + "SELECT ch.path, ch.status, sym.id FROM ch JOIN sym USING (file_path)",
    "git_hunk_lines": "SELECT o_orderkey, unnest(range(s, s + c))::INT AS line FROM (SELECT o_orderkey, (o_custkey % 90 + 1) AS s, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE o_orderkey % 7 END AS c FROM orders)",
    "git_status_decode": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'modified' WHEN 1 THEN 'deleted' WHEN 2 THEN 'added' WHEN 3 THEN 'renamed' WHEN 4 THEN 'added' ELSE 'modified' END AS status FROM orders",
}
