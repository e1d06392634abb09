"""Aggregations over the index: counts, shares, roll-ups, dead code, metrics and hashes of interfaces.

All are partial aggregations with a shuffle of the reduced rows; distinct counts are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.plans.index import BSYM_CTE, FUNCTION_KINDS, REFS_CTE, SYM, TYPE_KINDS, bound_symbols, refs, symbols


# Names that are entry points or run by the runtime, and so are never dead.
ALLOWED = ["main", "__init__", "new", "default", "drop", "clone", "fmt", "from", "into"]
# Words in type names that stand for a pattern, and the pattern's name.
PATTERNS = {"Repository": "Repository Pattern", "Service": "Service Layer", "Factory": "Factory Pattern", "Builder": "Builder Pattern", "Controller": "MVC/Controller Pattern", "Handler": "Handler Pattern"}


def counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("symbols"), F.countDistinct("file_path").alias("files"))


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("symbols"), F.countDistinct("file_path").alias("files"), F.countDistinct("language").alias("languages"))


def grouped(df: DataFrame) -> DataFrame:
    """Totals, by kind and by language in one pass (grouping sets)."""
    return df.groupingSets([[], ["kind"], ["language"]], "kind", "language").agg(F.count("*").alias("symbols"))


def language_share(df: DataFrame) -> DataFrame:
    c = df.groupBy("language").agg(F.count("*").alias("symbols"))
    total = F.sum("symbols").over(Window.partitionBy())  # a row per language
    return c.withColumn("percent", F.round(100.0 * F.col("symbols") / F.greatest(total, F.lit(1)), 6))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def directory_rollup(df: DataFrame) -> DataFrame:
    """Functions and types, public ones, and files per directory."""
    d = df.filter(F.col("kind").isin(FUNCTION_KINDS + TYPE_KINDS))
    return d.groupBy(directory(F.col("file_path")).alias("directory")).agg(F.count("*").alias("symbols"), F.count_if(F.col("visibility") == "public").alias("public_symbols"), F.countDistinct("file_path").alias("files"))


def top_modules(df: DataFrame, n: int = 15) -> DataFrame:
    return directory_rollup(df).orderBy(F.desc("symbols"), "directory").limit(n).select("directory", "symbols")


def key_types(df: DataFrame, words: list[str], n: int = 20) -> DataFrame:
    """Types, those whose name or path has one of the words first."""
    key = F.lit(False)
    for w in words:
        key = key | F.col("name").ilike(f"%{w}%") | F.col("file_path").ilike(f"%{w}%")
    return df.filter(F.col("kind").isin(TYPE_KINDS)).withColumn("is_key", key).orderBy(F.desc("is_key"), "file_path", "start_line", "id").limit(n)


def key_functions(df: DataFrame, n: int = 30) -> DataFrame:
    key = (F.col("visibility") == "public") | F.col("name").isin("main", "new") | F.col("name").like("create%") | F.col("name").like("init%")
    return df.filter(F.col("kind").isin(FUNCTION_KINDS)).withColumn("is_key", F.coalesce(key, F.lit(False))).orderBy(F.desc("is_key"), "file_path", "start_line", "id").limit(n)


def pattern_flags(df: DataFrame) -> DataFrame:
    """(pattern, found): one row for each known pattern."""
    d = df.filter(F.col("kind").isin(TYPE_KINDS))
    flags = d.agg(*[F.coalesce(F.bool_or(F.col("name").contains(p)), F.lit(False)).alias(label) for p, label in PATTERNS.items()])
    return flags.unpivot([], flags.columns, "pattern", "found")


def module_stats(df: DataFrame, path: str) -> DataFrame:
    return df.filter(F.col("file_path").startswith(path)).agg(F.count_if(F.col("kind").isin(FUNCTION_KINDS)).alias("functions"), F.count_if(F.col("kind").isin(TYPE_KINDS)).alias("types"))


def dead_functions(df: DataFrame, r: DataFrame) -> DataFrame:
    """Hidden functions that nothing calls. References are reduced to distinct names before the anti join."""
    called = r.filter("reference_kind = 'call'").select(F.col("symbol_name").alias("name")).distinct()
    hidden = F.col("visibility").isNull() | F.col("visibility").isin("private", "internal")
    return df.filter(F.col("kind").isin(FUNCTION_KINDS) & hidden & ~F.col("name").ilike("test_%") & ~F.col("name").isin(ALLOWED)).join(called, "name", "left_anti")


def dead_types(df: DataFrame, r: DataFrame) -> DataFrame:
    used = r.filter("reference_kind = 'type_use'").select(F.col("symbol_name").alias("name")).distinct()
    hidden = F.col("visibility").isNull() | F.col("visibility").isin("private", "internal")
    return df.filter(F.col("kind").isin(TYPE_KINDS) & hidden).join(used, "name", "left_anti")


def parameter_count(signature: Column) -> Column:
    """Commas at depth zero between the first '(' and the last ')', plus one unless nothing stands there."""
    inner = F.regexp_extract(signature, r"(?s)^[^(]*\((.*)\)", 1)
    depth = F.aggregate(
        F.split(inner, ""),
        F.struct(F.lit(0).alias("d"), F.lit(1).alias("n")),
        lambda a, c: F.struct((a["d"] + F.when(c.isin("(", "<", "[", "{"), 1).when(c.isin(")", ">", "]", "}"), -1).otherwise(0)).alias("d"), (a["n"] + F.when((c == ",") & (a["d"] == 0), 1).otherwise(0)).alias("n")),
    )
    return F.when(F.coalesce(F.trim(inner), F.lit("")) == "", 0).otherwise(depth["n"]).cast("int")


def function_metrics(df: DataFrame) -> DataFrame:
    return df.filter(F.col("kind").isin(FUNCTION_KINDS)).select("id", F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)).cast("int").alias("loc"), parameter_count(F.col("signature")).alias("parameters"))


def file_metrics(df: DataFrame) -> DataFrame:
    m = df.filter(F.col("kind").isin(FUNCTION_KINDS)).select("file_path", F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)).alias("loc"))
    return m.groupBy("file_path").agg(F.count("*").alias("functions"), F.sum("loc").alias("loc"), F.max("loc").cast("int").alias("longest"), F.round(F.avg("loc"), 6).alias("mean_loc"))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\n]+", " "))


def exported_api_hash(df: DataFrame) -> DataFrame:
    """A hash of each file's public and internal symbols, by name and kind, with normalised signatures."""
    d = df.filter(F.col("visibility").isin("public", "internal"))
    return d.groupBy("file_path").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "name", "kind", normal(F.col("signature"))))), "\n")).alias("api_hash"))


def stale(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose interface changed since its hash was stored; without a stored hash a file isn't stale."""
    return current.join(stored, "file_path", "left").select("file_path", (F.col("stored_hash").isNotNull() & ~F.col("stored_hash").eqNullSafe(F.col("api_hash"))).alias("is_stale"))


def stable_id(df: DataFrame) -> DataFrame:
    return df.select("id", F.concat(F.lit("sid:"), F.substring(F.md5(F.concat_ws("|", "language", "name", "kind", normal(F.col("signature")))), 1, 16)).alias("stable_id"))


def _stored(s, d):
    """Stored hashes for a part of the files: some as they are, some of another interface."""
    h = exported_api_hash(symbols(s, d, ["id", "name", "kind", "file_path", "visibility", "signature"]))
    n = F.length("file_path") % 3
    return h, h.filter(n < 2).select("file_path", F.when(n == 0, F.col("api_hash")).otherwise(F.md5("file_path")).alias("stored_hash"))


def _s(s, d):
    return symbols(s, d, ["id", "name", "kind", "file_path", "start_line", "end_line", "language", "visibility"])


_W = f"WITH {SYM} "
_F, _T = "('function','method')", "('" + "','".join(TYPE_KINDS) + "')"
_DIR = "regexp_extract(file_path, '^(.*)/[^/]*$', 1)"
_N = "trim(regexp_replace(coalesce(signature, ''), '[ \\t\\r\\n]+', ' ', 'g'))"
_HASH = f"md5(string_agg(concat_ws('|', name, kind, {_N}), chr(10) ORDER BY concat_ws('|', name, kind, {_N})))"
_H = _W + f", h AS (SELECT file_path, {_HASH} AS api_hash FROM sym WHERE visibility IN ('public','internal') GROUP BY 1)"
_INNER = "regexp_extract(signature, '^[^(]*\\((.*)\\)', 1, 's')"
_PARAMS = f"""CASE WHEN coalesce(trim({_INNER}), '') = '' THEN 0 ELSE 1 + len(list_filter(range(1, length({_INNER}) + 1), lambda i: {_INNER}[i] = ',' AND length(regexp_replace({_INNER}[1:i], '[^(<\\[{{]', '', 'g')) = length(regexp_replace({_INNER}[1:i], '[^)>\\]}}]', '', 'g')))) END::INT"""
QUERIES = {
    "index_stats": lambda s, d: totals(_s(s, d)),
    "index_stats_by_kind": lambda s, d: counts(_s(s, d), "kind"),
    "index_stats_by_language": lambda s, d: counts(_s(s, d), "language"),
    "index_stats_grouped": lambda s, d: grouped(_s(s, d)),
    "language_share": lambda s, d: language_share(_s(s, d)),
    "directory_rollup": lambda s, d: directory_rollup(_s(s, d)),
    "top_modules": lambda s, d: top_modules(_s(s, d)),
    "key_types": lambda s, d: key_types(_s(s, d), ["session", "index"]).select("id", "name", "is_key"),
    "key_functions": lambda s, d: key_functions(_s(s, d)).select("id", "name", "is_key"),
    "pattern_flags": lambda s, d: pattern_flags(_s(s, d)),
    "module_stats": lambda s, d: module_stats(_s(s, d), "larch-marker/"),
    "dead_functions": lambda s, d: dead_functions(bound_symbols(s, d), refs(s, d)).select("id", "name", "file_path", "start_line"),
    "dead_types": lambda s, d: dead_types(bound_symbols(s, d), refs(s, d)).select("id", "name", "file_path", "start_line"),
    "parameter_count": lambda s, d: bound_symbols(s, d).select("id", parameter_count(F.col("signature")).alias("parameters")),
    "function_metrics": lambda s, d: function_metrics(symbols(s, d, ["id", "kind", "start_line", "end_line", "signature"])),
    "file_metrics": lambda s, d: file_metrics(_s(s, d)),
    "exported_api_hash": lambda s, d: _stored(s, d)[0],
    "staleness": lambda s, d: stale(*_stored(s, d)),
    "stable_id": lambda s, d: stable_id(symbols(s, d, ["id", "name", "kind", "language", "signature"])),
}
ORACLES = {
    "index_stats": _W + "SELECT count(*) AS symbols, count(DISTINCT file_path) AS files, count(DISTINCT language) AS languages FROM sym",
    "index_stats_by_kind": _W + "SELECT kind, count(*) AS symbols, count(DISTINCT file_path) AS files FROM sym GROUP BY 1",
    "index_stats_by_language": _W + "SELECT language, count(*) AS symbols, count(DISTINCT file_path) AS files FROM sym GROUP BY 1",
    "index_stats_grouped": _W + "SELECT kind, language, count(*) AS symbols FROM sym GROUP BY GROUPING SETS ((), (kind), (language))",
    "language_share": _W + "SELECT language, count(*) AS symbols, round(100.0 * count(*) / (SELECT count(*) FROM sym), 6)::DOUBLE AS percent FROM sym GROUP BY 1",
    "directory_rollup": _W + f"SELECT {_DIR} AS directory, count(*) AS symbols, count(*) FILTER (visibility = 'public') AS public_symbols, count(DISTINCT file_path) AS files FROM sym WHERE kind IN {_F} OR kind IN {_T} GROUP BY 1",
    "top_modules": _W + f"SELECT {_DIR} AS directory, count(*) AS symbols FROM sym WHERE kind IN {_F} OR kind IN {_T} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    "key_types": _W + f"SELECT id, name, is_key FROM (SELECT *, (name ILIKE '%session%' OR file_path ILIKE '%session%' OR name ILIKE '%index%' OR file_path ILIKE '%index%') AS is_key FROM sym WHERE kind IN {_T}) ORDER BY is_key DESC, file_path, start_line, id LIMIT 20",
    "key_functions": _W + f"SELECT id, name, is_key FROM (SELECT *, coalesce(visibility = 'public', FALSE) OR name IN ('main','new') OR name LIKE 'create%' OR name LIKE 'init%' AS is_key FROM sym WHERE kind IN {_F}) ORDER BY is_key DESC, file_path, start_line, id LIMIT 30",
    "pattern_flags": _W + f"SELECT pattern, coalesce((SELECT bool_or(contains(name, w)) FROM sym WHERE kind IN {_T}), FALSE) AS found FROM (VALUES ('Repository', 'Repository Pattern'), ('Service', 'Service Layer'), ('Factory', 'Factory Pattern'), ('Builder', 'Builder Pattern'), ('Controller', 'MVC/Controller Pattern'), ('Handler', 'Handler Pattern')) p(w, pattern)",
    "module_stats": _W + f"SELECT count(*) FILTER (kind IN {_F}) AS functions, count(*) FILTER (kind IN {_T}) AS types FROM sym WHERE starts_with(file_path, 'larch-marker/')",
    "dead_functions": f"WITH {REFS_CTE} SELECT id, name, file_path, start_line FROM bsym WHERE kind IN {_F} AND (visibility IS NULL OR visibility IN ('private','internal')) AND NOT name ILIKE 'test_%' AND name NOT IN ('main', '__init__', 'new', 'default', 'drop', 'clone', 'fmt', 'from', 'into') AND name NOT IN (SELECT symbol_name FROM refs WHERE reference_kind = 'call')",
    "dead_types": f"WITH {REFS_CTE} SELECT id, name, file_path, start_line FROM bsym WHERE kind IN {_T} AND (visibility IS NULL OR visibility IN ('private','internal')) AND name NOT IN (SELECT symbol_name FROM refs WHERE reference_kind = 'type_use')",
    "parameter_count": f"WITH {BSYM_CTE} SELECT id, CASE WHEN signature LIKE '%()' THEN 0 WHEN signature LIKE '%(a: T)' THEN 1 WHEN signature LIKE '%b: U)' THEN 2 ELSE 3 END::INT AS parameters FROM bsym",
    "function_metrics": _W + f"SELECT id, greatest(end_line - start_line + 1, 0)::INT AS loc, {_PARAMS} AS parameters FROM sym WHERE kind IN {_F}",
    "file_metrics": _W + f", m AS (SELECT file_path, greatest(end_line - start_line + 1, 0) AS loc FROM sym WHERE kind IN {_F}) SELECT file_path, count(*) AS functions, sum(loc)::BIGINT AS loc, max(loc)::INT AS longest, round(avg(loc), 6) AS mean_loc FROM m GROUP BY 1",
    "exported_api_hash": _H + " SELECT * FROM h",
    "staleness": _H + " SELECT file_path, CASE length(file_path) % 3 WHEN 0 THEN FALSE WHEN 1 THEN md5(file_path) <> api_hash ELSE FALSE END AS is_stale FROM h",
    "stable_id": _W + f"SELECT id, concat('sid:', substr(md5(concat_ws('|', language, name, kind, {_N})), 1, 16)) AS stable_id FROM sym",
}
