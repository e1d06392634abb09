"""Writes into the index's tables, as functions from tables to tables; `store` makes them durable.

Every write is a merge by key: what is written replaces what has the same key, and nothing else changes. Deletes take the
rows of a file along in every table that knows files or the file's symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.plans.index import BSYM_CTE, EDGES_CTE, IMPORTS_CTE, TAGS_CTE, bound_symbols, call_edges, file_tags, imports, refs
from codeloom.sources.store import KEYS, upsert
from codeloom.sources.tables import table

# The versions of the schema, and the columns that each adds to tables (with what they hold before).
VERSIONS: dict[int, dict[str, dict[str, str]]] = {
    1: {"symbols": {"visibility": "string", "signature": "string", "doc_comment": "string", "parent": "string"}},
    2: {"symbols": {"source_type": "string default 'project'", "dependency_id": "long"}},
    3: {"symbols": {"scope_id": "long", "fqdn": "string"}},
    4: {"symbols": {"stable_id": "string"}},
    5: {"files": {"content_hash": "string"}},
    6: {"file_meta": {"exported_hash": "string", "confidence": "double default 1.0"}},
    7: {"file_tags": {"source": "string default 'inferred'", "confidence": "double default 1.0"}},
    8: {"symbols": {"generic_params": "array<struct<name:string,bounds:array<string>,default:string>>", "return_type": "string"}},
    9: {"files": {"last_size": "long", "last_mtime_ns": "long"}},
}


def version_of(tables: dict[str, DataFrame]) -> int:
    """The highest version all of whose columns are there."""
    have = 0
    for v, change in sorted(VERSIONS.items()):
        if any(t in tables and c not in tables[t].columns for t, cs in change.items() for c in cs):
            break
        have = v
    return have


def migrate(tables: dict[str, DataFrame], to: int | None = None) -> tuple[dict[str, DataFrame], int]:
    """The tables at a version, by the steps from their own on; a version above the known ones is an error."""
    to = max(VERSIONS) if to is None else to
    if to > max(VERSIONS):
        raise ValueError(f"version {to} is newer than {max(VERSIONS)}")
    out = dict(tables)
    for v in range(version_of(tables) + 1, to + 1):
        for t, columns in VERSIONS[v].items():
            for c, kind in columns.items() if t in out else ():
                type_, _, default = kind.partition(" default ")
                if c not in out[t].columns:
                    out[t] = out[t].withColumn(c, F.expr(default or "null").cast(type_))
    return out, to


def put(base: DataFrame, rows: DataFrame, table_name: str, order: str | None = None) -> DataFrame:
    """A table with rows put in by its key: scopes, call edges, metrics, digests, projects, profiles, nodes, tags, metadata."""
    return upsert(base, rows, KEYS[table_name], order)


def refresh_metadata(files: DataFrame, updates: DataFrame) -> DataFrame:
    """Files with size and time of `updates` (path, last_size, last_mtime_ns); hashes stay, unknown paths are no rows."""
    u = updates.groupBy("path").agg(F.max(F.struct("last_mtime_ns", "last_size")).alias("u"))
    keep = [c for c in files.columns if c not in ("last_size", "last_mtime_ns")]
    j = files.join(u, "path", "left")
    return j.select(*keep, *[F.when(F.col("u").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(c)).alias(c) for c in ("last_size", "last_mtime_ns")]).select(*files.columns)


def set_hashes(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files with the content hashes of `hashes` (path, content_hash); a path that isn't known yet becomes a row of unknown
    language."""
    h = hashes.groupBy("path").agg(F.max("content_hash").alias("new_hash"))
    j = files.join(h, "path", "full")
    known = files.schema["path"]
    rest: list[Column] = [F.coalesce("new_hash", "content_hash").alias("content_hash") if c == "content_hash" else F.coalesce(F.col("language"), F.lit("unknown")).alias(c) if c == "language" else F.col(c) for c in files.columns if c != known.name]
    return j.select("path", *rest).select(*files.columns)


def mark_indexed(dependencies: DataFrame, ids: DataFrame) -> DataFrame:
    """Dependencies whose id is among `ids` (id) are indexed from now on."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return dependencies.join(hit, "id", "left").withColumn("is_indexed", F.coalesce("_hit", "is_indexed", F.lit(False))).select(*dependencies.columns)


def replace_file_tags(tags: DataFrame, rows: DataFrame) -> DataFrame:
    """The tags of every file in `rows` are replaced by those there."""
    return tags.join(rows.select("file_path").distinct(), "file_path", "left_anti").select(*tags.columns).unionByName(rows.select(*tags.columns).distinct())


def cascade(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Every table without what the files (column path) own: symbols, their metrics, references in the file or to its symbols
    by id, edges in the file or from or to its symbols, imports, scopes, tags and the file itself."""
    gone = paths.select("path").distinct()
    by_file = {"symbols": "file_path", "refs": "referenced_in_file", "imports": "file_path", "scopes": "file_path", "call_edges": "referenced_in_file", "files": "path", "file_tags": "file_path", "file_meta": "file_path"}
    by_symbol = {"refs": ["symbol_id"], "metrics": ["symbol_id"], "call_edges": ["caller_id", "callee_id"]}
    ids = tables["symbols"].join(gone.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select("id") if "symbols" in tables else None
    out = {}
    for name, t in tables.items():
        if name in by_file:
            t = t.join(gone.withColumnRenamed("path", by_file[name]), by_file[name], "left_anti").select(*t.columns)
        for c in by_symbol.get(name, []) if ids is not None else []:
            if c in t.columns:
                t = t.join(ids.withColumnRenamed("id", c), c, "left_anti").select(*t.columns)
        out[name] = t
    return out


def _counts(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        c = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def _cascade(s, d):
    b, e = bound_symbols(s, d), call_edges(s, d)
    metrics = b.select(F.col("id").alias("symbol_id"), F.lit(1).alias("incoming_refs"))
    t = {"symbols": b, "refs": refs(s, d), "imports": imports(s, d), "file_tags": file_tags(s, d), "metrics": metrics, "call_edges": e, "scopes": b.select("id", "file_path")}
    after = cascade(t, b.filter(F.col("file_path").like("%brand_1_/m1.rs")).select(F.col("file_path").alias("path")))
    return _counts({f"{k} before": v for k, v in t.items()} | {f"{k} after": v for k, v in after.items()})


def _files(s, d):
    return table(s, d, "files").groupBy("path").agg(F.max(F.struct("indexed_at", "language", "content_hash", "last_size", "last_mtime_ns")).alias("v")).select("path", "v.language", "v.content_hash", "v.last_size", "v.last_mtime_ns")


def _refresh(s, d):
    f = _files(s, d)
    u = f.filter(F.length("path") % 2 == 0).select("path", (F.coalesce("last_size", F.lit(0)) + 1).alias("last_size"), F.lit(7).cast("long").alias("last_mtime_ns")).unionByName(s.createDataFrame([("nowhere", 1, 1)], "path string, last_size long, last_mtime_ns long"))
    return refresh_metadata(f, u).select("path", "content_hash", "last_size", "last_mtime_ns")


def _hashes(s, d):
    f = _files(s, d)
    h = f.filter(F.length("path") % 3 == 0).select("path", F.md5("path").alias("content_hash")).unionByName(s.createDataFrame([("new/file", "abc")], "path string, content_hash string"))
    return set_hashes(f, h).select("path", "language", "content_hash")


def _nodes(s, d):
    """Old and new states of the nodes: the newest of each id replaces the rest."""
    n = table(s, d, "project_nodes").select("id", "updated_at", "name", "symbol_count")
    first = n.groupBy("id").agg(F.min(F.struct("updated_at", "name", "symbol_count")).alias("v")).select("id", "v.updated_at", "v.name", "v.symbol_count")
    return put(first, n, "nodes", "updated_at")


def _marked(s, d):
    dep = table(s, d, "dependencies").distinct()
    return mark_indexed(dep, dep.filter("id % 4 = 1").select("id")).groupBy("is_indexed").agg(F.count("*").alias("n"))


def _tags(s, d):
    t = file_tags(s, d)
    new = t.filter(F.col("file_path").like("%/m1.rs")).select("file_path", F.lit("infra").alias("category"), F.lit("test").alias("tag"), F.lit(1.0).alias("confidence"))
    return replace_file_tags(t, new).groupBy("category", "tag").agg(F.count("*").alias("files"))


def _migrated(s, d):
    old = {"symbols": bound_symbols(s, d).select("id", "name", "kind", "file_path"), "files": _files(s, d).select("path", "language"), "file_tags": file_tags(s, d).select("file_path", "category", "tag")}
    new, _ = migrate(old)
    return new["symbols"].groupBy("source_type", F.col("stable_id").isNull().alias("no_stable_id")).agg(F.count("*").alias("n")).withColumn("columns", F.lit(len(new["symbols"].columns))).withColumn("from_version", F.lit(version_of(old))).withColumn("to_version", F.lit(version_of(new)))


_GONE = "gone AS (SELECT DISTINCT file_path AS p FROM bsym WHERE file_path LIKE '%brand_1_/m1.rs'), ids AS (SELECT id FROM bsym WHERE file_path IN (SELECT p FROM gone))"
_F = "f AS (SELECT path, language, content_hash, last_size, last_mtime_ns FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, language DESC NULLS LAST, content_hash DESC NULLS LAST, last_size DESC NULLS LAST, last_mtime_ns DESC NULLS LAST) AS rn FROM files WHERE path IS NOT NULL) WHERE rn = 1)"
_PARTS = [("symbols", "bsym", "file_path NOT IN (SELECT p FROM gone)"), ("refs", "refs", "referenced_in_file NOT IN (SELECT p FROM gone)"), ("imports", "imports", "file_path NOT IN (SELECT p FROM gone)"), ("file_tags", "file_tags", "file_path NOT IN (SELECT p FROM gone)"), ("metrics", "bsym", "id NOT IN (SELECT id FROM ids)"), ("call_edges", "call_edges", "referenced_in_file NOT IN (SELECT p FROM gone) AND caller_id NOT IN (SELECT id FROM ids)"), ("scopes", "bsym", "file_path NOT IN (SELECT p FROM gone)")]
QUERIES = {
    "cascade_all_tables": _cascade,
    "refresh_metadata": _refresh,
    "set_content_hashes": _hashes,
    "put_nodes": _nodes,
    "mark_dependencies_indexed": _marked,
    "replace_file_tags": _tags,
    "migrate_schema": _migrated,
}
ORACLES = {
    "cascade_all_tables": f"WITH {EDGES_CTE}, {IMPORTS_CTE}, {TAGS_CTE}, {_GONE} " + " UNION ALL ".join(f"SELECT '{n} before' AS name, count(*) AS n FROM {t} UNION ALL SELECT '{n} after', count(*) FROM {t} WHERE {w}" for n, t, w in _PARTS),
    "refresh_metadata": f"WITH {_F} SELECT path, content_hash, CASE WHEN length(path) % 2 = 0 THEN coalesce(last_size, 0) + 1 ELSE last_size END AS last_size, CASE WHEN length(path) % 2 = 0 THEN 7 ELSE last_mtime_ns END AS last_mtime_ns FROM f",
    "set_content_hashes": f"WITH {_F} SELECT path, coalesce(language, 'unknown') AS language, CASE WHEN length(path) % 3 = 0 THEN md5(path) ELSE content_hash END AS content_hash FROM f UNION ALL SELECT 'new/file', 'unknown', 'abc'",
    "put_nodes": "SELECT id, updated_at, name, symbol_count FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, name DESC, symbol_count DESC) AS rn FROM project_nodes WHERE id IS NOT NULL) WHERE rn = 1",
    "mark_dependencies_indexed": "SELECT id % 4 = 1 OR coalesce(is_indexed, FALSE) AS is_indexed, count(*) AS n FROM (SELECT DISTINCT * FROM dependencies) GROUP BY 1",
    "replace_file_tags": f"WITH {TAGS_CTE} SELECT category, tag, count(*) AS files FROM (SELECT * FROM file_tags WHERE file_path NOT LIKE '%/m1.rs' UNION ALL SELECT DISTINCT file_path, 'infra', 'test', 1.0::DOUBLE FROM file_tags WHERE file_path LIKE '%/m1.rs') GROUP BY 1, 2",
    "migrate_schema": f"WITH {BSYM_CTE} SELECT 'project' AS source_type, TRUE AS no_stable_id, count(*) AS n, 15 AS columns, 0 AS from_version, 9 AS to_version FROM bsym",
}
