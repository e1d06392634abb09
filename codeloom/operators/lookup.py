"""Lookups, listings, predicates and projections over the index.

Every listing ends in a total order (the id last), so that a limit cuts the same rows everywhere. Matching by pattern
ignores case, equality doesn't. Filters stand on columns of the scan wherever validity allows: a symbol's name may
differ between its states, so validity is decided first, on the columns that are needed only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import lang
from codeloom.plans.index import BSYM_CTE, FUNCTION_KINDS, IMPORTS_CTE, NO_DEFINITION, REFS_CTE, SYM, TYPE_KINDS, bound_symbols, imports, refs, symbols
from codeloom.sources.tables import table

OUT = ["id", "name", "kind", "file_path", "start_line", "end_line"]
_O = ", ".join(OUT)


def glob_like(pattern: str) -> str:
    """Name globs as LIKE patterns: * and ? become % and _."""
    return pattern.replace("*", "%").replace("?", "_")


def options(df: DataFrame, kinds: list[str] | None = None, languages: list[str] | None = None, file: str | None = None, name: str | None = None) -> DataFrame:
    """The common filters: kinds, languages, a substring of the path and a glob of the name, both without case."""
    if kinds:
        df = df.filter(F.col("kind").isin(kinds))
    if languages:
        df = df.filter(F.col("language").isin(languages))
    if file:
        df = df.filter(F.col("file_path").ilike(f"%{file}%"))
    return df.filter(F.col("name").ilike(glob_like(name))) if name else df


def definitions(df: DataFrame, name: str, parent_name: str | None = None, language: str | None = None, limit: int | None = None) -> DataFrame:
    """Symbols of exactly this name that define something, by file and line; all of them unless a limit is given."""
    d = df.filter((F.col("name") == name) & ~F.col("kind").isin(NO_DEFINITION))
    if language:
        d = d.filter(F.col("language") == language)
    if parent_name is not None:
        d = d.join(df.filter(F.col("name") == parent_name).select(F.col("id").alias("parent")), "parent", "left_semi")
    return d.orderBy("file_path", "start_line", "id").limit(limit) if limit is not None else d


def listing(df: DataFrame, limit: int = 1000) -> DataFrame:
    return df.orderBy("file_path", "start_line", "id").limit(limit)


def all_symbols(df: DataFrame, limit: int = 1000) -> DataFrame:
    """Functions, then types, each by file and line; the limit cuts the concatenation."""
    b = F.when(F.col("kind").isin(FUNCTION_KINDS), 0).when(F.col("kind").isin(TYPE_KINDS), 1)
    return df.withColumn("branch", b).filter("branch is not null").orderBy("branch", "file_path", "start_line", "id").limit(limit)


def at_position(df: DataFrame, file: str, line: int, column: int = 0) -> DataFrame:
    """The innermost symbol around a position: least lines, then the later start, then the id."""
    d = df.filter((F.col("file_path") == file) & (F.col("start_line") <= line) & (F.col("end_line") >= line))
    if column:
        d = d.filter(~((F.col("start_line") == line) & (F.col("start_column") > column)) & ~((F.col("end_line") == line) & (F.col("end_column") < column)))
    return d.orderBy(F.col("end_line") - F.col("start_line"), F.col("start_line").desc(), "id").limit(1)


def members(df: DataFrame, type_name: str) -> DataFrame:
    """Members of a type: its children by id, and methods and fields inside the span of its first definition."""
    types = df.filter((F.col("name") == type_name) & F.col("kind").isin(TYPE_KINDS))
    first = types.orderBy("file_path", "start_line", "id").limit(1).select(F.col("file_path").alias("tf"), F.col("start_line").alias("ts"), F.col("end_line").alias("te"), F.col("id").alias("tid"))
    children = df.join(types.select(F.col("id").alias("parent")), "parent", "left_semi")
    inside = df.filter(F.col("kind").isin("method", "field")).join(F.broadcast(first), (F.col("file_path") == F.col("tf")) & F.col("start_line").between(F.col("ts"), F.col("te")) & (F.col("end_line") <= F.col("te")), "left_semi")
    return children.select(*OUT).unionByName(inside.select(*OUT)).dropDuplicates(["id"])


def kind_code(kind: Column) -> Column:
    return lang.lookup(lang.KIND_CODES, kind)


def compact(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("name").alias("n"), kind_code(F.col("kind")).alias("k"), F.col("file_path").alias("f"), F.col("start_line").alias("l"))


def minimal(df: DataFrame) -> DataFrame:
    return df.select("id", F.format_string("%s:%s@%s:%d", "name", kind_code(F.col("kind")), "file_path", "start_line").alias("text"))


def project_dependencies(dependencies: DataFrame, include_dev: bool = True) -> DataFrame:
    d = dependencies.distinct()
    return d if include_dev else d.filter(~F.coalesce("is_dev", F.lit(False)))


def symbol_origin(df: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Where a symbol comes from: the project, or a dependency by name, version and ecosystem."""
    d = dependencies.groupBy(F.col("id").alias("dependency_id")).agg(F.max(F.struct("added_at", "name", "version", "ecosystem")).alias("d"))
    return df.join(d, "dependency_id", "left").select("id", F.coalesce("source_type", F.lit("project")).alias("source_type"), F.col("d.name").alias("dependency"), F.col("d.version").alias("version"), F.col("d.ecosystem").alias("ecosystem"))


def dependency_definitions(df: DataFrame, dependencies: DataFrame, name_glob: str, dependency: str) -> DataFrame:
    """Definitions within the dependencies of one name."""
    ids = dependencies.filter(F.col("name") == dependency).select(F.col("id").alias("dependency_id"))
    return df.filter((F.col("source_type") == "dependency") & F.col("name").ilike(glob_like(name_glob)) & ~F.col("kind").isin(NO_DEFINITION)).join(ids, "dependency_id", "left_semi")


def snippets(sources: DataFrame, df: DataFrame, context: int = 3, max_lines: int = 50) -> DataFrame:
    """Numbered lines of each symbol's text with context; a sign marks those within its span."""
    lines = sources.filter("body is not null").select("path", "body").distinct().select("path", F.posexplode(F.split(F.regexp_replace("body", r"\r\n?", "\n"), "\n")).alias("i", "text"))
    lines = lines.select("path", (F.col("i") + 1).alias("line"), F.regexp_replace("text", "^﻿", "").alias("text"))
    s = df.select("id", F.col("file_path").alias("path"), "start_line", "end_line")
    hit = lines.join(s, "path").filter(F.col("line").between(F.col("start_line") - context, F.col("end_line") + context) & (F.col("line") < F.col("start_line") - context + max_lines))
    return hit.select("id", "line", F.concat(F.when(F.col("line").between(F.col("start_line"), F.col("end_line")), ">").otherwise(" "), F.format_string("%4d | %s", "line", "text")).alias("text"))


def references(r: DataFrame, name: str, file: str | None = None, limit: int = 100) -> DataFrame:
    d = r.filter(F.col("symbol_name") == name)
    d = d.filter(F.col("referenced_in_file").ilike(f"%{file}%")) if file else d
    return d.orderBy("referenced_in_file", "line", "column_num", "reference_kind").limit(limit)


def resolved_imports(i: DataFrame, df: DataFrame, file: str) -> DataFrame:
    """Imports of a file with the ids of the definitions they name, sorted."""
    d = df.filter(~F.col("kind").isin(NO_DEFINITION)).select(F.col("name").alias("imported_symbol"), "id")
    return i.filter(F.col("file_path") == file).join(d, "imported_symbol", "left").groupBy("file_path", "imported_path", "imported_symbol", "import_type").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("definitions"))


def importers(i: DataFrame, path: str) -> DataFrame:
    return i.filter(F.col("imported_path").ilike(f"%{path}")).select("file_path").distinct()


def receiver_type(df: DataFrame, receiver: str, file: str) -> DataFrame:
    """The type behind a receiver in a file: the parent of the variable of that name, else a type of that name."""
    v = df.filter((F.col("name") == receiver) & (F.col("kind") == "variable") & (F.col("file_path") == file)).select("parent", "start_line", "id")
    p = v.join(df.select(F.col("id").alias("parent"), F.col("name").alias("type_name")), "parent").orderBy("start_line", "id").limit(1).select(F.lit(0).alias("o"), "type_name")
    t = df.filter((F.col("name") == receiver) & F.col("kind").isin(TYPE_KINDS)).select(F.lit(1).alias("o"), F.col("name").alias("type_name")).limit(1)
    return p.unionByName(t).orderBy("o").limit(1).select("type_name")


def import_class(text: Column) -> Column:
    return F.when(text.endswith("*") | text.endswith("._"), "wildcard").when(text.contains("::") | text.contains(".") | text.contains("/"), "module").otherwise("symbol")


def _s(spark, d, *extra):
    return symbols(spark, d, list(dict.fromkeys([*OUT, *extra])))


FN, TYPE, FILE, VAR = "emitQueue", "LayerFrame", "fjord-node/manifestkit-8/app/services/graph_tag.java", "offset"
VAR_FILE = "larch-marker/manifestkit-2/tests/token/span_frame.java"
_W = f"WITH {SYM} "
QUERIES = {
    "find_definition": lambda s, d: definitions(_s(s, d), FN).select(*OUT),
    "find_definition_by_parent": lambda s, d: definitions(_s(s, d, "parent", "language"), FN, None, "java").select(*OUT),
    "find_members_by_parent_name": lambda s, d: definitions(_s(s, d, "parent"), "matchEdge", "DigestShard").select(*OUT),
    "list_functions": lambda s, d: listing(options(_s(s, d, "language"), FUNCTION_KINDS, ["rust", "java"], "src/", "*e?*queue*")).select(*OUT),
    "list_types": lambda s, d: listing(options(_s(s, d), TYPE_KINDS)).select(*OUT),
    "list_symbols_all": lambda s, d: all_symbols(_s(s, d)).select(*OUT),
    "file_outline": lambda s, d: _s(s, d, "start_column").filter(F.col("file_path") == FILE).select(*OUT, "start_column"),
    "outline_line_range": lambda s, d: _s(s, d).filter((F.col("file_path") == FILE) & (F.col("start_line") >= 10) & (F.col("end_line") <= 80)).select(*OUT),
    "symbol_at_position": lambda s, d: at_position(_s(s, d, "start_column", "end_column"), FILE, 20, 4).select(*OUT),
    "symbol_members": lambda s, d: members(_s(s, d, "parent"), TYPE),
    "symbol_origin": lambda s, d: symbol_origin(symbols(s, d, ["id", "source_type", "dependency_id"]), table(s, d, "dependencies")),
    "dependency_definitions": lambda s, d: dependency_definitions(_s(s, d, "source_type", "dependency_id"), table(s, d, "dependencies"), "*e*", "tidewire").select(*OUT),
    "project_dependencies": lambda s, d: project_dependencies(table(s, d, "dependencies"), False).select("id", "project_id", "name", "version"),
    "indexed_files": lambda s, d: symbols(s, d, ["file_path"]).distinct(),
    "search_regex": lambda s, d: _s(s, d).filter(F.col("name").rlike("^(emit|load)[A-Z_].*(Queue|queue)") & F.col("kind").isin(FUNCTION_KINDS + TYPE_KINDS)).select(*OUT),
    "minimal_format": lambda s, d: minimal(_s(s, d)),
    "compact_format": lambda s, d: compact(_s(s, d)),
    "visibility_or_null": lambda s, d: symbols(s, d, ["id", "visibility"]).filter(F.col("visibility").isNull() | F.col("visibility").isin("private", "internal")),
    "snippet_window": lambda s, d: snippets(table(s, d, "sources"), _s(s, d).filter(F.col("kind").isin(TYPE_KINDS))),
    "find_references": lambda s, d: references(refs(s, d), "small_ring"),
    "find_references_in_file": lambda s, d: references(refs(s, d), "small_ring", "BRAND_1"),
    "file_imports_resolved": lambda s, d: resolved_imports(imports(s, d), bound_symbols(s, d), "mod7/f0.rs"),
    "file_importers": lambda s, d: importers(imports(s, d), "brand_11/M1.rs"),
    "infer_receiver_type": lambda s, d: receiver_type(_s(s, d, "parent"), VAR, VAR_FILE),
    "import_classification": lambda s, d: imports(s, d).select("imported_path").distinct().select("imported_path", import_class(F.col("imported_path")).alias("import_class"), F.element_at(F.split("imported_path", r"[/.:]+"), -1).alias("last_segment")),
}
_TYPES, _FNS = "('" + "','".join(TYPE_KINDS) + "')", "('function','method')"
_CODE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lang.KIND_CODES.items()) + " END"
ORACLES = {
    "find_definition": _W + f"SELECT {_O} FROM sym WHERE name = '{FN}' AND kind NOT IN ('import','variable')",
    "find_definition_by_parent": _W + f"SELECT {_O} FROM sym WHERE name = '{FN}' AND kind NOT IN ('import','variable') AND language = 'java'",
    "find_members_by_parent_name": _W + f"SELECT {_O} FROM sym WHERE name = 'matchEdge' AND kind NOT IN ('import','variable') AND parent IN (SELECT id FROM sym WHERE name = 'DigestShard')",
    "list_functions": _W + f"SELECT {_O} FROM sym WHERE kind IN {_FNS} AND language IN ('rust','java') AND file_path ILIKE '%src/%' AND name ILIKE '%e_%queue%' ORDER BY file_path, start_line, id LIMIT 1000",
    "list_types": _W + f"SELECT {_O} FROM sym WHERE kind IN {_TYPES} ORDER BY file_path, start_line, id LIMIT 1000",
    "list_symbols_all": _W + f"SELECT {_O} FROM sym WHERE kind IN {_TYPES} OR kind IN {_FNS} ORDER BY CASE WHEN kind IN {_FNS} THEN 0 ELSE 1 END, file_path, start_line, id LIMIT 1000",
    "file_outline": _W + f"SELECT {_O}, start_column FROM sym WHERE file_path = '{FILE}'",
    "outline_line_range": _W + f"SELECT {_O} FROM sym WHERE file_path = '{FILE}' AND start_line >= 10 AND end_line <= 80",
    "symbol_at_position": _W + f"SELECT {_O} FROM sym WHERE file_path = '{FILE}' AND start_line <= 20 AND end_line >= 20 AND NOT (start_line = 20 AND start_column > 4) AND NOT (end_line = 20 AND end_column < 4) ORDER BY end_line - start_line, start_line DESC, id LIMIT 1",
    "symbol_members": _W + f", t AS (SELECT * FROM sym WHERE name = '{TYPE}' AND kind IN {_TYPES}), f AS (SELECT * FROM t ORDER BY file_path, start_line, id LIMIT 1) SELECT {_O} FROM sym s WHERE parent IN (SELECT id FROM t) OR (kind IN ('method','field') AND EXISTS (SELECT 1 FROM f WHERE f.file_path = s.file_path AND s.start_line BETWEEN f.start_line AND f.end_line AND s.end_line <= f.end_line))",
    "symbol_origin": _W + ", d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY added_at DESC, name DESC) AS rn FROM dependencies) WHERE rn = 1) SELECT s.id, coalesce(s.source_type, 'project') AS source_type, d.name AS dependency, d.version, d.ecosystem FROM sym s LEFT JOIN d ON d.id = s.dependency_id",
    "dependency_definitions": _W + f"SELECT {_O} FROM sym WHERE source_type = 'dependency' AND name ILIKE '%e%' AND kind NOT IN ('import','variable') AND dependency_id IN (SELECT id FROM dependencies WHERE name = 'tidewire')",
    "project_dependencies": "SELECT DISTINCT id, project_id, name, version FROM dependencies WHERE NOT coalesce(is_dev, FALSE)",
    "indexed_files": _W + "SELECT DISTINCT file_path FROM sym",
    "search_regex": _W + f"SELECT {_O} FROM sym WHERE regexp_matches(name, '^(emit|load)[A-Z_].*(Queue|queue)') AND (kind IN {_TYPES} OR kind IN {_FNS})",
    "minimal_format": _W + f"SELECT id, concat(name, ':', {_CODE}, '@', file_path, ':', start_line) AS text FROM sym",
    "compact_format": _W + f"SELECT id, name AS n, {_CODE} AS k, file_path AS f, start_line AS l FROM sym",
    "visibility_or_null": _W + "SELECT id, visibility FROM sym WHERE visibility IS NULL OR visibility IN ('private','internal')",
    "snippet_window": _W + f", src AS (SELECT DISTINCT path, body FROM sources WHERE body IS NOT NULL), li AS (SELECT path, unnest(string_split(regexp_replace(body, '\\r\\n?', chr(10), 'g'), chr(10))) AS text, generate_subscripts(string_split(regexp_replace(body, '\\r\\n?', chr(10), 'g'), chr(10)), 1)::INT AS line FROM src) SELECT s.id, li.line, concat(CASE WHEN li.line BETWEEN s.start_line AND s.end_line THEN '>' ELSE ' ' END, lpad(li.line::VARCHAR, greatest(4, length(li.line::VARCHAR))::INT, ' '), ' | ', ltrim(li.text, chr(65279))) AS text FROM sym s JOIN li ON li.path = s.file_path AND li.line BETWEEN s.start_line - 3 AND s.end_line + 3 AND li.line < s.start_line + 47 WHERE s.kind IN {_TYPES}",
    "find_references": f"WITH {REFS_CTE} SELECT * FROM refs WHERE symbol_name = 'small_ring' ORDER BY referenced_in_file, line, column_num, reference_kind LIMIT 100",
    "find_references_in_file": f"WITH {REFS_CTE} SELECT * FROM refs WHERE symbol_name = 'small_ring' AND referenced_in_file ILIKE '%BRAND_1%' ORDER BY referenced_in_file, line, column_num, reference_kind LIMIT 100",
    "file_imports_resolved": f"WITH {BSYM_CTE}, {IMPORTS_CTE} SELECT i.file_path, imported_path, imported_symbol, import_type, coalesce(string_agg(b.id, ',' ORDER BY b.id), '') AS definitions FROM imports i LEFT JOIN bsym b ON b.name = i.imported_symbol WHERE i.file_path = 'mod7/f0.rs' GROUP BY 1, 2, 3, 4",
    "file_importers": f"WITH {IMPORTS_CTE} SELECT DISTINCT file_path FROM imports WHERE imported_path ILIKE '%brand_11/M1.rs'",
    "infer_receiver_type": _W + f", v AS (SELECT p.name AS type_name, s.start_line, s.id FROM sym s JOIN sym p ON p.id = s.parent WHERE s.name = '{VAR}' AND s.kind = 'variable' AND s.file_path = '{VAR_FILE}' ORDER BY 2, 3 LIMIT 1), t AS (SELECT name AS type_name FROM sym WHERE name = '{VAR}' AND kind IN {_TYPES} LIMIT 1) SELECT type_name FROM (SELECT 0 AS o, type_name FROM v UNION ALL SELECT 1, type_name FROM t) ORDER BY o LIMIT 1",
    "import_classification": f"WITH {IMPORTS_CTE} SELECT DISTINCT imported_path, CASE WHEN imported_path LIKE '%*' THEN 'wildcard' WHEN contains(imported_path, '::') OR contains(imported_path, '.') OR contains(imported_path, '/') THEN 'module' ELSE 'symbol' END AS import_class, list_last(regexp_split_to_array(imported_path, '[/.:]+')) AS last_segment FROM imports",
}
