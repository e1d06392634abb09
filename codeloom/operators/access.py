"""Access by id, composite answers, envelopes and cursors, searches within parts of the index, import paths, overlay states.

All are compositions of filters, equi joins and aggregations; where the condition is a substring, candidates come from an
equi join on three signs.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import encode_cursor
from codeloom.operators import graph
from codeloom.operators.graph import call_graph, callers, degrees, pagerank
from codeloom.operators.lookup import OUT, definitions, references
from codeloom.operators.search import _bm25_sql, bm25
from codeloom.operators.stats import stable_id
from codeloom.plans.index import BSYM_CTE, EDGES_CTE, FUNCTION_KINDS, IMPORTS_CTE, NO_DEFINITION, SYM, TAGS_CTE, TYPE_KINDS, bound_symbols, call_edges, file_tags, imports, refs, symbols
from codeloom.sources.tables import table


def get_symbols(base: DataFrame, ids: DataFrame, overlay: DataFrame | None = None) -> DataFrame:
    """The symbols of the ids (column id); an unsaved document's symbol goes before the index's of the same id."""
    wanted = ids.select("id").distinct()
    hit = base.join(wanted, "id", "left_semi")
    if overlay is None:
        return hit
    over = overlay.select(*base.columns).join(wanted, "id", "left_semi")
    return over.unionByName(hit.join(over.select("id"), "id", "left_anti"))


def by_stable_id(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, stable_id) of the symbols with the stable ids wanted."""
    return stable_id(df).join(wanted.select("stable_id").distinct(), "stable_id", "left_semi").select("id", "stable_id")


def references_composite(r: DataFrame, edges: DataFrame, i: DataFrame, df: DataFrame, name: str, depth: int = 1, limit: int = 100) -> DataFrame:
    """(section, name, file, line): references, the callers up to a depth, and the files that import the file of the first
    definition."""
    a = references(r, name, None, limit).select(F.lit("reference").alias("section"), F.col("reference_kind").alias("name"), F.col("referenced_in_file").alias("file"), "line")
    b = callers(edges, name, depth).select(F.lit("caller").alias("section"), F.col("caller_name").alias("name"), F.col("referenced_in_file").alias("file"), "line").distinct()
    first = definitions(df, name, limit=1).select(F.lower("file_path").alias("defined_in"))  # one row
    c = i.join(F.broadcast(first), F.endswith(F.lower("imported_path"), F.col("defined_in")), "left_semi").select(F.lit("importer").alias("section"), F.lit(None).cast("string").alias("name"), F.col("file_path").alias("file"), F.lit(None).cast("int").alias("line")).distinct()
    return a.unionByName(b).unionByName(c)


def analyze_calls(edges: DataFrame, df: DataFrame, name: str, direction: str = "both", depth: int = 3) -> DataFrame:
    """(direction, name, other, depth): calls out of a function, into it, or both."""
    out = None
    if direction in ("out", "both"):
        out = call_graph(edges, df, name, depth)[1].select(F.lit("out").alias("direction"), F.col("caller_name").alias("name"), F.col("callee_name").alias("other"), "depth").distinct()
    if direction in ("in", "both"):
        into = callers(edges, name, depth).select(F.lit("in").alias("direction"), F.col("symbol_name").alias("name"), F.col("caller_name").alias("other"), "depth").distinct()
        out = into if out is None else out.unionByName(into)
    return out


def symbol_metrics(edges: DataFrame, df: DataFrame, iterations: int = 3) -> DataFrame:
    """(symbol_id, pagerank, incoming_refs, outgoing_refs) of every function, by its name; 0 where nothing is known."""
    m = degrees(edges).join(pagerank(edges, iterations), "name", "left")
    d = df.filter(F.col("kind").isin(FUNCTION_KINDS)).select(F.col("id").alias("symbol_id"), "name")
    return d.join(m, "name", "left").select("symbol_id", F.round(F.coalesce("rank", F.lit(0.0)), 6).alias("pagerank"), F.coalesce("incoming", F.lit(0)).alias("incoming_refs"), F.coalesce("outgoing", F.lit(0)).alias("outgoing_refs"))


def metrics_of(metrics: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each id asked for; ids without metrics have zeros."""
    zero = {"pagerank": 0.0, "incoming_refs": 0, "outgoing_refs": 0}
    return ids.select(F.col("id").alias("symbol_id")).distinct().join(metrics, "symbol_id", "left").fillna(zero)


def dependency_source(df: DataFrame, texts: DataFrame, names: DataFrame, context: int = 3) -> DataFrame:
    """(id, line, text): lines of the dependencies' texts (path, body) around each definition of the names, '>' before those
    within its span; a definition without a text has one row without a line."""
    d = df.filter((F.col("source_type") == "dependency") & ~F.col("kind").isin(NO_DEFINITION)).join(names.select("name").distinct(), "name", "left_semi")
    t = texts.filter("body is not null").select(F.col("path").alias("file_path"), F.split(F.regexp_replace("body", r"\r\n?", "\n"), "\n").alias("ls"))
    first = F.greatest(F.col("start_line") - context, F.lit(1))
    part = F.slice("ls", first, F.greatest(F.least(F.col("end_line") + context, F.size("ls")) - first + 1, F.lit(0)))
    found = d.join(t, "file_path", "left").select("id", "start_line", "end_line", first.alias("first"), F.posexplode_outer(F.when(F.col("ls").isNotNull(), part)).alias("i", "x"))
    line = F.col("first") + F.col("i")
    return found.select("id", line.cast("int").alias("line"), F.when(line.isNotNull(), F.concat(F.when(line.between(F.col("start_line"), F.col("end_line")), ">").otherwise(" "), F.lit(" "), F.format_string("%4d | %s", line, F.col("x")))).alias("text"))


def contains_join(names: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """Pairs (name, rows of `texts`) whose text holds the name, without a cross join: a text that holds a name holds the
    name's first three signs, so both meet on those, and the condition is checked on what has met."""
    n = names.select("name").filter("name <> ''").distinct().withColumn("g", F.substring("name", 1, 3))
    size = F.length(text)
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(size - k + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, k)))))
    met = texts.filter(F.length(text) > 0).withColumn("g", F.explode(grams)).join(n, "g")
    return met.filter(F.contains(F.col(text), F.col("name"))).drop("g")


def envelope_counts(df: DataFrame, limit: int) -> DataFrame:
    """(part, key, n): rows in all, rows returned under the limit, and rows by kind."""
    kinds = df.groupBy("kind").agg(F.count("*").alias("n"))  # a row per kind
    total = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    none = F.lit(None).cast("string").alias("key")
    return kinds.select(F.lit("by_kind").alias("part"), F.col("kind").alias("key"), "n").unionByName(total.select(F.lit("total").alias("part"), none, "n")).unionByName(total.select(F.lit("returned").alias("part"), none, F.least("n", F.lit(limit).cast("long")).alias("n")))


def envelope(df: DataFrame, order: list, limit: int = 20, offset: int = 0, max_bytes: int | None = None) -> dict:
    """An answer as a dictionary: items, counts by kind, total, returned, truncated and the cursor of the next page. The
    items are a page, so at most `limit` rows come to the driver."""
    counts = {(r.part, r.key): r.n for r in envelope_counts(df, limit).collect()}
    rows = [r.asDict(recursive=True) for r in df.orderBy(*order).offset(offset).limit(limit).collect()]
    total, kept = counts["total", None], rows
    if max_bytes is not None:
        while kept and len(json.dumps(kept, default=str).encode()) > max_bytes:
            kept = kept[:-1]
    end = offset + len(kept)
    return {"items": kept, "counts": {"total": total, "returned": len(kept), "by_kind": {k: n for (p, k), n in counts.items() if p == "by_kind"}}, "truncated": len(kept) < len(rows), "next_cursor": encode_cursor({"offset": end}) if total > end else None}


def next_cursor(offset: int, limit: int, total: Column) -> Column:
    """The cursor of the page after this one where there is more, else null; the same code as `encode_cursor`."""
    at = offset + limit
    return F.when(total > at, encode_cursor({"offset": at}))


def search_dependencies(df: DataFrame, dependencies: DataFrame, query: str, dependency: str | None = None, limit: int = 100) -> DataFrame:
    d = df.filter("source_type = 'dependency'")
    if dependency is not None:
        d = d.join(dependencies.filter(F.col("name") == dependency).select(F.col("id").alias("dependency_id")).distinct(), "dependency_id", "left_semi")
    return bm25(d, "id", ["name", "signature", "doc_comment"], query, limit)


def search_module(df: DataFrame, module_path: str, query: str, limit: int = 100) -> DataFrame:
    return bm25(df.filter(F.col("file_path").ilike(f"%{module_path}%")), "id", ["name", "signature", "doc_comment"], query, limit)


def search_file_meta(meta: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(file_path, score) of files whose description or purpose answers the query."""
    return bm25(meta, "file_path", ["doc1", "purpose"], query, limit)


def parse_tag(tag: Column) -> tuple[Column, Column]:
    """(category, name) of 'category:name'; without a colon the category is null."""
    has = F.instr(tag, ":") > 0
    return F.when(has, F.substring_index(tag, ":", 1)), F.when(has, F.substring(tag, F.instr(tag, ":") + 1, F.length(tag))).otherwise(tag)


def module_path(file: Column) -> Column:
    """A Rust file's module by its path behind src/: folders and the file, joined by '::', without mod and lib."""
    rel = F.when(file.contains("src/"), F.regexp_replace(file, r"^.*?src/", "")).otherwise(F.lit(""))
    parts = F.filter(F.transform(F.split(rel, "/"), lambda x: F.regexp_replace(x, r"\.rs$", "")), lambda x: (x != "") & ~x.isin("mod", "lib"))
    return F.array_join(parts, "::")


def normalise_import(path: Column, file: Column, language: Column) -> Column:
    """An import path as seen from the root: self:: and super:: by the file's module, relative paths by its folder."""
    own = module_path(file)
    joined = lambda base, rest: F.when(base == "", rest).otherwise(F.concat(base, F.lit("::"), rest))
    rust = F.when(path.startswith("self::"), joined(own, F.substring(path, 7, 1 << 20))).when(path.startswith("super::"), joined(F.when(own.contains("::"), F.regexp_replace(own, "::[^:]*$", "")).otherwise(""), F.substring(path, 8, 1 << 20))).otherwise(path)
    steps = F.split(F.concat(F.regexp_replace(file, "[^/]*$", ""), path), "/")
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.when(language == "rust", rust).when((language == "typescript") & path.startswith("."), F.array_join(walked, "/")).otherwise(path)


def imported_name(path: Column, symbol: Column, language: Column) -> Column:
    """The name an import asks definitions for: its symbol, else the last step of its path by the language's separator."""
    last = F.when(language.isin("java", "kotlin", "python"), F.element_at(F.split(path, r"\."), -1)).when(language == "go", F.element_at(F.split(path, "/"), -1)).when(language == "rust", F.element_at(F.split(path, "::"), -1)).otherwise(F.lit("default"))
    return F.coalesce(symbol, last)


def resolve_imports(i: DataFrame, df: DataFrame) -> DataFrame:
    """(file_path, imported_path, imported_symbol, normalised, definition_id) of imports (language too); definitions of the name asked for, those of the
    import's own language; null if there is none. Wildcards ask for no name."""
    d = df.filter(~F.col("kind").isin(NO_DEFINITION)).select(F.col("name").alias("asked"), "language", F.col("id").alias("definition_id"))
    w = i.withColumn("normalised", normalise_import(F.col("imported_path"), F.col("file_path"), F.col("language"))).withColumn("asked", F.when(F.col("import_type") != "wildcard", imported_name(F.col("imported_path"), F.col("imported_symbol"), F.col("language"))))
    return w.join(d, ["asked", "language"], "left").select("file_path", "imported_path", "imported_symbol", "normalised", "definition_id")


def run_plan(current: DataFrame, tracked: DataFrame) -> DataFrame:
    """(mode, path): the files an index run must read. Without any tracked state the run is cold and reads all; else it reads
    what isn't tracked with the same size and time, or hash."""
    cold = tracked.limit(1).count() == 0
    if cold:
        return current.select(F.lit("cold").alias("mode"), "path")
    t = tracked.select("path", F.col("content_hash").alias("h"), F.col("last_size").alias("s"), F.col("last_mtime_ns").alias("m"))
    same = ((F.col("s") == F.col("last_size")) & (F.col("m") == F.col("last_mtime_ns"))) | (F.col("h") == F.col("content_hash"))
    return current.join(t, "path", "left").filter(~F.coalesce(same, F.lit(False))).select(F.lit("incremental").alias("mode"), "path")


def overlay_states(actions: DataFrame) -> DataFrame:
    """(doc, version, dirty) of the documents that an overlay holds after all actions (arrival, doc, action, version): an
    update makes a document dirty, commit makes it clean, discard removes it, clear removes every document."""
    cleared = actions.filter("action = 'clear'").agg(F.coalesce(F.max("arrival"), F.lit(-1)).alias("cleared"))
    at = lambda a: F.coalesce(F.max(F.when(F.col("action") == a, F.col("arrival"))), F.lit(-1)).alias(a)
    s = actions.filter("action <> 'clear'").groupBy("doc").agg(at("update"), at("commit"), at("discard"), F.max_by(F.when(F.col("action") == "update", F.col("version")), F.when(F.col("action") == "update", F.col("arrival"))).alias("version"))
    live = s.crossJoin(F.broadcast(cleared)).filter((F.col("update") > F.col("discard")) & (F.col("update") > F.col("cleared")))
    return live.select("doc", "version", (F.col("update") > F.col("commit")).alias("dirty"))


def _s(s, d, *extra):
    return symbols(s, d, list(dict.fromkeys([*OUT, *extra])))


def _meta(s, d):
    return s.sql(_META_SQL, documents=table(s, d, "documents"))


def _imports(s, d):
    return s.sql(_IMPORT_SQL, sym=symbols(s, d, ["name", "kind", "language", "file_path"]).filter(F.col("kind").isin(TYPE_KINDS)))


def _actions(s, d):
    return s.sql(_ACTIONS, events=table(s, d, "events"))


def _dep_texts(df: DataFrame) -> DataFrame:
    """Texts of the dependencies' files, made of their paths: two of three files have one."""
    f = df.filter("source_type = 'dependency'").select(F.col("file_path").alias("path")).distinct().filter(F.length("path") % 3 < 2)
    return f.select("path", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat("path", F.lit(" "), i.cast("string"))), "\n").alias("body"))


def _dep_names(df: DataFrame) -> DataFrame:
    """One name for each kind of the dependencies' symbols."""
    return df.filter("source_type = 'dependency'").groupBy("kind").agg(F.min("name").alias("name"))


def _states(s, d):
    from codeloom.operators.incremental import T1, T2, state_at

    f = table(s, d, "files")
    return state_at(f, T2), state_at(f, T1)


def _plans(s, d):
    now, before = _states(s, d)
    return run_plan(now, before).unionByName(run_plan(now, before.limit(0))).groupBy("mode").agg(F.count("*").alias("files"))


_META_SQL = "SELECT path AS file_path, max(text) AS doc1, max(source) AS purpose FROM {documents} WHERE path IS NOT NULL GROUP BY path"
_IMPORT_SQL = """SELECT DISTINCT file_path, language, CASE length(name) % 4 WHEN 0 THEN concat('self::a::', name) WHEN 1 THEN concat('super::', name) WHEN 2 THEN concat('../x/./', name) ELSE concat('org.b.', name) END AS imported_path,
 CASE WHEN length(file_path) % 3 = 0 THEN name ELSE NULL END AS imported_symbol, CASE WHEN length(file_path) % 5 = 0 THEN 'wildcard' ELSE 'symbol' END AS import_type FROM {sym}"""
_ACTIONS = "SELECT event_id AS arrival, user_id AS doc, CASE event_type WHEN 'view' THEN 'commit' WHEN 'signup' THEN 'discard' WHEN 'error' THEN CASE WHEN event_id % 997 = 0 THEN 'clear' ELSE 'update' END ELSE 'update' END AS action, event_id % 1000 AS version FROM {events}"
_W, _O = f"WITH {SYM} ", ", ".join(OUT)
_N = "trim(regexp_replace(coalesce(signature, ''), '[ \\t\\r\\n]+', ' ', 'g'))"
_F, _T = "('function','method')", "('" + "','".join(TYPE_KINDS) + "')"
QUERIES = {
    "get_symbols_by_id": lambda s, d: get_symbols(_s(s, d), symbols(s, d, ["parent"]).filter("parent is not null").select(F.col("parent").alias("id"))).select(*OUT),
    "get_symbols_overlay_first": lambda s, d: get_symbols(bound_symbols(s, d).select(*OUT), bound_symbols(s, d).filter("seq % 3 < 2").select("id"), bound_symbols(s, d).filter("kind = 'trait'").withColumn("name", F.upper("name")).select(*OUT)),
    "symbols_by_stable_id": lambda s, d: by_stable_id(symbols(s, d, ["id", "name", "kind", "language", "signature"]), stable_id(symbols(s, d, ["id", "name", "kind", "language", "signature"])).groupBy(F.substring("stable_id", 5, 1).alias("k")).agg(F.min("stable_id").alias("stable_id"))),
    "references_composite": lambda s, d: references_composite(refs(s, d), call_edges(s, d), imports(s, d), bound_symbols(s, d), "small_ring", 1),
    "analyze_call_graph_both": lambda s, d: analyze_calls(call_edges(s, d), bound_symbols(s, d), "small_ring", "both", 2),
    "symbol_metrics": lambda s, d: symbol_metrics(call_edges(s, d), bound_symbols(s, d)),
    "symbol_metrics_batch": lambda s, d: metrics_of(symbol_metrics(call_edges(s, d), bound_symbols(s, d)), bound_symbols(s, d).select("id")),
    "dependency_source": lambda s, d: dependency_source(_s(s, d, "source_type"), _dep_texts(_s(s, d, "source_type")), _dep_names(_s(s, d, "source_type"))),
    "substring_links": lambda s, d: contains_join(bound_symbols(s, d).filter("kind = 'trait'").select("name"), bound_symbols(s, d).filter("kind = 'function' and language = 'java'").select("id", "signature"), "signature").select("name", "id"),
    "envelope_counts": lambda s, d: envelope_counts(_s(s, d), 20),
    "page_cursor": lambda s, d: _s(s, d).groupBy("kind").agg(F.count("*").alias("n")).select("kind", next_cursor(40, 20, F.col("n")).alias("cursor")),
    "search_dependencies": lambda s, d: search_dependencies(_s(s, d, "signature", "doc_comment", "source_type", "dependency_id"), table(s, d, "dependencies"), "queue"),
    "search_module": lambda s, d: search_module(_s(s, d, "signature", "doc_comment"), "src/core", "queue"),
    "search_file_meta": lambda s, d: search_file_meta(_meta(s, d), "snapshot cach"),
    "tag_parse": lambda s, d: file_tags(s, d).select(F.when(F.length("tag") % 2 == 0, F.concat_ws(":", "category", "tag", F.lit("x"))).otherwise(F.col("tag")).alias("tag")).distinct().select("tag", parse_tag(F.col("tag"))[0].alias("category"), parse_tag(F.col("tag"))[1].alias("name")),
    "imports_resolved": lambda s, d: resolve_imports(_imports(s, d), symbols(s, d, ["id", "name", "kind", "language"])),
    "index_run_plan": _plans,
    "overlay_lifecycle": lambda s, d: overlay_states(_actions(s, d)),
}
_MOD = "array_to_string(list_filter(list_transform(string_split(CASE WHEN contains(file_path, 'src/') THEN regexp_replace(file_path, '^.*?src/', '') ELSE '' END, '/'), lambda x: regexp_replace(x, '\\.rs$', '')), lambda x: x NOT IN ('', 'mod', 'lib')), '::')"
_REST = "CASE WHEN starts_with(imported_path, 'self::') THEN substr(imported_path, 7) ELSE substr(imported_path, 8) END"
_BASE = f"CASE WHEN starts_with(imported_path, 'self::') THEN {_MOD} WHEN contains({_MOD}, '::') THEN regexp_replace({_MOD}, '::[^:]*$', '') ELSE '' END"
_DIRS = "list_filter(string_split(regexp_replace(file_path, '[^/]*$', ''), '/'), lambda x: x NOT IN ('', '.'))"
_DEPSYM = "dsym AS (SELECT * FROM sym WHERE source_type = 'dependency')"
ORACLES = {
    "get_symbols_by_id": _W + f"SELECT {_O} FROM sym WHERE id IN (SELECT parent FROM sym)",
    "get_symbols_overlay_first": f"WITH {BSYM_CTE} SELECT id, CASE WHEN kind = 'trait' THEN upper(name) ELSE name END AS name, kind, file_path, start_line, end_line FROM bsym WHERE seq % 3 < 2",
    "symbols_by_stable_id": _W + f", x AS (SELECT id, concat('sid:', substr(md5(concat_ws('|', language, name, kind, {_N})), 1, 16)) AS stable_id FROM sym) SELECT id, stable_id FROM x WHERE stable_id IN (SELECT min(stable_id) FROM x GROUP BY substr(stable_id, 5, 1))",
    "references_composite": f"WITH {EDGES_CTE}, {IMPORTS_CTE}, f AS (SELECT file_path FROM bsym WHERE name = 'small_ring' ORDER BY file_path, start_line, id LIMIT 1) SELECT * FROM (SELECT 'reference' AS section, reference_kind AS name, referenced_in_file AS file, line FROM refs WHERE symbol_name = 'small_ring' ORDER BY referenced_in_file, line, column_num, reference_kind LIMIT 100) UNION ALL SELECT DISTINCT 'caller', caller_name, referenced_in_file, line FROM call_edges WHERE symbol_name = 'small_ring' UNION ALL SELECT DISTINCT 'importer', NULL, i.file_path, NULL FROM imports i, f WHERE i.imported_path ILIKE concat('%', f.file_path)",
    "analyze_call_graph_both": graph._BFS + ", l1 AS (SELECT DISTINCT symbol_name, caller_name FROM call_edges WHERE symbol_name = 'small_ring'), l2 AS (SELECT DISTINCT symbol_name, caller_name FROM call_edges WHERE symbol_name IN (SELECT caller_name FROM l1) AND symbol_name <> 'small_ring') SELECT 'out' AS direction, caller_name AS name, callee_name AS other, 1 AS depth FROM st WHERE caller_name IN (SELECT name FROM n0) UNION ALL SELECT 'out', caller_name, callee_name, 2 FROM st WHERE caller_name IN (SELECT name FROM n1) UNION ALL SELECT 'in', symbol_name, caller_name, 1 FROM l1 UNION ALL SELECT 'in', symbol_name, caller_name, 2 FROM l2",
    "symbol_metrics": f"WITH {EDGES_CTE}" + graph._RANK + f", i AS (SELECT symbol_name AS name, count(*) AS c FROM call_edges GROUP BY 1), o AS (SELECT caller_name AS name, count(*) AS c FROM call_edges GROUP BY 1) SELECT b.id AS symbol_id, round(coalesce(rank, 0), 6) AS pagerank, coalesce(i.c, 0) AS incoming_refs, coalesce(o.c, 0) AS outgoing_refs FROM bsym b LEFT JOIN r3 USING (name) LEFT JOIN i USING (name) LEFT JOIN o USING (name) WHERE b.kind IN {_F}",
    "symbol_metrics_batch": f"WITH {EDGES_CTE}" + graph._RANK + f", i AS (SELECT symbol_name AS name, count(*) AS c FROM call_edges GROUP BY 1), o AS (SELECT caller_name AS name, count(*) AS c FROM call_edges GROUP BY 1) SELECT b.id AS symbol_id, CASE WHEN b.kind IN {_F} THEN round(coalesce(rank, 0), 6) ELSE 0.0::DOUBLE END AS pagerank, CASE WHEN b.kind IN {_F} THEN coalesce(i.c, 0) ELSE 0 END AS incoming_refs, CASE WHEN b.kind IN {_F} THEN coalesce(o.c, 0) ELSE 0 END AS outgoing_refs FROM bsym b LEFT JOIN r3 USING (name) LEFT JOIN i USING (name) LEFT JOIN o USING (name)",
    "dependency_source": _W + f", {_DEPSYM}, q AS (SELECT * FROM dsym WHERE name IN (SELECT min(name) FROM dsym GROUP BY kind) AND kind NOT IN ('import', 'variable')), l AS (SELECT id, file_path, start_line, end_line, unnest(CASE WHEN length(file_path) % 3 < 2 THEN range(greatest(start_line - 3, 1), greatest(least(end_line + 3, 60) + 1, greatest(start_line - 3, 1))) END) AS line FROM q) SELECT id, line::INT AS line, concat(CASE WHEN line BETWEEN start_line AND end_line THEN '>' ELSE ' ' END, ' ', lpad(line::VARCHAR, 4, ' '), ' | ', file_path, ' ', line) AS text FROM l UNION ALL SELECT id, NULL, NULL FROM q WHERE length(file_path) % 3 = 2 OR start_line - 3 > 60",
    "substring_links": f"WITH {BSYM_CTE} SELECT DISTINCT t.name, b.id FROM bsym b JOIN bsym t ON contains(b.signature, t.name) WHERE t.kind = 'trait' AND b.kind = 'function' AND b.language = 'java'",
    "envelope_counts": _W + "SELECT 'by_kind' AS part, kind AS key, count(*) AS n FROM sym GROUP BY kind UNION ALL SELECT 'total', NULL, count(*) FROM sym UNION ALL SELECT 'returned', NULL, least(count(*), 20) FROM sym",
    "page_cursor": _W + "SELECT kind, CASE WHEN count(*) > 60 THEN rtrim(replace(replace(base64(encode('{\"offset\":60}')), '+', '-'), '/', '_'), '=') END AS cursor FROM sym GROUP BY kind",
    "search_dependencies": _bm25_sql(_W + f", {_DEPSYM}", "id", "dsym", ["name", "signature", "doc_comment"], "queue", 100) + "SELECT * FROM best",
    "search_module": _bm25_sql(_W + ", m AS (SELECT * FROM sym WHERE file_path ILIKE '%src/core%')", "id", "m", ["name", "signature", "doc_comment"], "queue", 100) + "SELECT * FROM best",
    "search_file_meta": _bm25_sql(f"WITH meta AS ({_META_SQL.format(documents='documents')})", "file_path", "meta", ["doc1", "purpose"], "snapshot cach", 20) + "SELECT * FROM best",
    "tag_parse": f"WITH {TAGS_CTE}, t AS (SELECT DISTINCT CASE WHEN length(tag) % 2 = 0 THEN concat(category, ':', tag, ':x') ELSE tag END AS tag FROM file_tags) SELECT tag, CASE WHEN contains(tag, ':') THEN regexp_extract(tag, '^([^:]*):', 1) END AS category, regexp_replace(tag, '^[^:]*:', '') AS name FROM t",
    "imports_resolved": _W + f", t AS (SELECT * FROM sym WHERE kind IN {_T}), i AS ({_IMPORT_SQL.format(sym='t')}), w AS (SELECT *, CASE WHEN language = 'rust' AND (starts_with(imported_path, 'self::') OR starts_with(imported_path, 'super::')) THEN CASE WHEN ({_BASE}) = '' THEN {_REST} ELSE concat({_BASE}, '::', {_REST}) END WHEN language = 'typescript' AND starts_with(imported_path, '.') THEN concat(array_to_string({_DIRS}[1:greatest(len({_DIRS}) - 1, 0)], '/'), CASE WHEN len({_DIRS}) > 1 THEN '/' ELSE '' END, substr(imported_path, 4, 2), substr(imported_path, 8)) ELSE imported_path END AS normalised, CASE WHEN import_type <> 'wildcard' THEN coalesce(imported_symbol, CASE WHEN language IN ('java', 'kotlin', 'python') THEN string_split(imported_path, '.')[-1] WHEN language = 'go' THEN string_split(imported_path, '/')[-1] WHEN language = 'rust' THEN string_split(imported_path, '::')[-1] ELSE 'default' END) END AS asked FROM i) SELECT w.file_path, imported_path, imported_symbol, normalised, d.id AS definition_id FROM w LEFT JOIN (SELECT * FROM sym WHERE kind NOT IN ('import', 'variable')) d ON d.name = w.asked AND d.language = w.language",
    "overlay_lifecycle": f"WITH a AS ({_ACTIONS.format(events='events')}), c AS (SELECT coalesce(max(arrival), -1) AS c FROM a WHERE action = 'clear'), s AS (SELECT doc, coalesce(max(arrival) FILTER (action = 'update'), -1) AS u, coalesce(max(arrival) FILTER (action = 'commit'), -1) AS k, coalesce(max(arrival) FILTER (action = 'discard'), -1) AS x, arg_max(version, arrival) FILTER (action = 'update') AS version FROM a WHERE action <> 'clear' GROUP BY doc) SELECT doc, version, u > k AS dirty FROM s, c WHERE u > x AND u > c",
}


def _plan_oracle() -> str:
    from codeloom.operators.incremental import _PRE

    return _PRE + "SELECT 'cold' AS mode, count(*) AS files FROM p WHERE status <> 'stale' UNION ALL SELECT 'incremental', count(*) FROM p WHERE status IN ('new', 'changed')"


ORACLES["index_run_plan"] = _plan_oracle()
