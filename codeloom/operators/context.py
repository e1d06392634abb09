"""Answers put together for a reader: snippets of a place or symbol, the bundle around a query, the overview within a budget,
and calls with what is known about their receivers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import redact
from codeloom.operators.project import compass
from codeloom.operators.search import diversify, prefix_search
from codeloom.plans.index import EDGES_CTE, FUNCTION_KINDS, IMPORTS_CTE, REFS_CTE, SYM, bound_symbols, call_edges, imports, inside, refs, symbols
from codeloom.sources.tables import table


def snippets_at(targets: DataFrame, df: DataFrame, texts: DataFrame, context: int = 3, max_lines: int = 50, expand: bool = True, secrets: bool = False) -> DataFrame:
    """(target, line, text) of the places asked for: `targets` is (target, file_path, line, symbol_id), by symbol where that is
    given, else by line. With `expand` a line's window is the innermost symbol around it; secrets are redacted line by line
    unless asked for. At most `max_lines` from the window's start."""
    spans = df.select(F.col("id").alias("symbol_id"), F.col("file_path").alias("sf"), F.col("start_line").alias("ss"), F.col("end_line").alias("se"))
    by_id = targets.filter("symbol_id is not null").join(spans, "symbol_id").select("target", F.col("sf").alias("file_path"), F.col("ss").alias("a"), F.col("se").alias("z"))
    lines = targets.filter("symbol_id is null").select("target", "file_path", "line")
    if expand:
        o = df.select("file_path", "start_line", "end_line")
        best = inside(lines, o, "file_path").groupBy("target").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("w"), "start_line", "end_line")).alias("b"))
        lines = lines.join(best, "target", "left").select("target", "file_path", F.coalesce("b.start_line", "line").alias("a"), F.coalesce("b.end_line", "line").alias("z"))
    else:
        lines = lines.select("target", "file_path", F.col("line").alias("a"), F.col("line").alias("z"))
    t = texts.filter("body is not null").select(F.col("path").alias("file_path"), F.split(F.regexp_replace("body", r"\r\n?", "\n"), "\n").alias("ls")).distinct()
    w = by_id.unionByName(lines).join(t, "file_path")
    first = F.greatest(F.col("a") - context, F.lit(1))
    n = F.least(F.least(F.col("z") + context, F.size("ls")) - first + 1, F.lit(max_lines))
    out = w.select("target", first.alias("first"), F.posexplode(F.slice("ls", first, F.greatest(n, F.lit(0)))).alias("i", "x"))
    return out.select("target", (F.col("first") + F.col("i")).cast("int").alias("line"), F.format_string("%4d | %s", F.col("first") + F.col("i"), F.col("x") if secrets else redact(F.col("x"))).alias("text"))


def context_bundle(df: DataFrame, edges: DataFrame, i: DataFrame, query: str, cards: int = 5, usages: int = 10, per_file: int = 2, neighbours: int = 5, import_rows: int = 10) -> DataFrame:
    """(part, name, file, line): cards of the best hits, usages of the first hit's name (of the first `usages` at most
    `per_file` a file), its callees and callers, imports of its file, and whether more hits were left out."""
    hit = prefix_search(df, query, cards + 1).select("name", "id", F.col("file_path").alias("file"), F.col("start_line").alias("line"))
    rank = F.row_number().over(Window.orderBy("name", "id"))  # at most cards + 1 rows
    hit = hit.withColumn("rank", rank)
    card = hit.filter(F.col("rank") <= cards).select(F.lit("card").alias("part"), "name", "file", "line")
    lead = F.broadcast(hit.filter("rank = 1").select(F.col("name").alias("lead"), F.col("file").alias("lead_file")))
    u = edges.join(lead, F.col("symbol_name") == F.col("lead")).orderBy("referenced_in_file", "line", "column_num", "caller_name").limit(usages)
    use = diversify(u, F.col("referenced_in_file"), per_file, ["line", "column_num", "caller_name"]).select(F.lit("usage").alias("part"), F.col("caller_name").alias("name"), F.col("referenced_in_file").alias("file"), "line")
    out = edges.join(lead, F.col("caller_name") == F.col("lead")).select(F.col("symbol_name").alias("name")).distinct().orderBy("name").limit(neighbours).select(F.lit("callee").alias("part"), "name", F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))
    into = edges.join(lead, F.col("symbol_name") == F.col("lead")).select(F.col("caller_name").alias("name")).distinct().orderBy("name").limit(neighbours).select(F.lit("caller").alias("part"), "name", F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))
    imp = i.join(lead, F.col("imported_path") == F.col("lead_file")).select("file_path").distinct().orderBy("file_path").limit(import_rows).select(F.lit("importer").alias("part"), F.lit(None).cast("string").alias("name"), F.col("file_path").alias("file"), F.lit(None).cast("int").alias("line"))
    more = hit.agg((F.count("*") > cards).alias("m")).filter("m").select(F.lit("truncated").alias("part"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))
    parts = [card, use, out, into, imp, more]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def within_budget(df: DataFrame, order: list, max_bytes: int) -> DataFrame:
    """The longest head of few rows, in an order, whose JSON is within a number of bytes, separators and brackets counted."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # an overview of some dozens of rows
    return df.withColumn("_b", F.sum(F.octet_length(F.to_json(F.struct(*df.columns))) + 1).over(w)).filter(F.col("_b") + 1 <= max_bytes).drop("_b")


def call_confidence_by_receiver(calls: DataFrame, df: DataFrame) -> DataFrame:
    """(call_id, candidates, confidence, reason) of calls (call_id, name, receiver_type, is_self, is_dynamic). Candidates are
    the functions of the name; a known receiver type keeps those whose parent's name has it, without case; of a call on
    self only methods count; one candidate is certain."""
    names = df.select("id", F.lower("name").alias("parent_name"))
    c = df.filter(F.col("kind").isin(FUNCTION_KINDS)).select("name", "kind", F.col("parent")).join(names.withColumnRenamed("id", "parent"), "parent", "left")
    j = calls.join(c, "name", "left")
    of_type = F.contains(F.col("parent_name"), F.lower("receiver_type"))
    fits = F.col("kind").isNotNull() & F.when(F.col("receiver_type").isNotNull(), F.coalesce(of_type, F.lit(False))).otherwise(F.lit(True)) & (~F.col("is_self") | (F.col("kind") == "method"))
    n = j.groupBy("call_id").agg(F.count_if(fits).alias("candidates"), F.count_if(F.col("kind").isNotNull()).alias("named"), F.max(F.col("receiver_type").isNotNull()).alias("typed"), F.max("is_dynamic").alias("dynamic"))
    reason: Column = F.when(F.col("dynamic"), "virtual_dispatch").when(F.col("candidates") > 1, "multiple_candidates").when((F.col("candidates") == 0) & (F.col("named") > 0) & F.col("typed"), "dynamic_receiver").when(F.col("candidates") == 0, "external_library")
    return n.select("call_id", "candidates", F.when((F.col("candidates") == 1) & ~F.col("dynamic"), "certain").otherwise("possible").alias("confidence"), reason.alias("reason"))


def _sc(s, d):
    return symbols(s, d, ["id", "name", "kind", "file_path", "start_line", "end_line", "parent"])


def _targets(s, d):
    """Structs by id, and line 12 of every text."""
    t = _sc(s, d).filter("kind = 'struct'").select(F.concat(F.lit("sid:"), "id").alias("target"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line"), F.col("id").alias("symbol_id"))
    p = table(s, d, "sources").filter("body is not null").select("path").distinct().select(F.concat("path", F.lit(":12")).alias("target"), F.col("path").alias("file_path"), F.lit(12).alias("line"), F.lit(None).cast("string").alias("symbol_id"))
    return t.unionByName(p)


def _calls(s, d):
    """Calls made of the valid functions: on a type, on self, dynamic, and on nothing known."""
    f = _sc(s, d).filter(F.col("kind").isin(FUNCTION_KINDS)).select("id", "name", "parent")
    names = _sc(s, d).select(F.col("id").alias("parent"), F.upper("name").alias("pn"))
    j = f.join(names, "parent", "left").withColumn("n", F.ascii(F.substring("id", 1, 1)) % 4)
    return j.select(F.col("id").alias("call_id"), F.when(F.col("n") == 3, F.concat("name", F.lit("_x"))).otherwise(F.col("name")).alias("name"), F.when(F.col("n") == 0, F.substring("pn", 1, 6)).when(F.col("n") == 1, "nothing").alias("receiver_type"), (F.col("n") == 2).alias("is_self"), (F.ascii(F.substring("id", 2, 1)) % 5 == 0).alias("is_dynamic"))


_W = f"WITH {SYM} "
_F = "('function','method')"
_SRC = "src AS (SELECT DISTINCT path, string_split(regexp_replace(body, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM sources WHERE body IS NOT NULL)"
_SECRETS = "x"
for _p in (
    r"""(api[_-]?key|apikey)\s*[=:]\s*["\']?[A-Za-z0-9_\-]{20,}["\']?""", r"""bearer\s+[A-Za-z0-9_\-\.]{20,}""", r"""(aws[_-]?access[_-]?key[_-]?id|aws[_-]?secret[_-]?access[_-]?key)\s*[=:]\s*["\']?[A-Za-z0-9/+=]{20,}["\']?""",
    r"""(private[_-]?key|secret[_-]?key|password|passwd|pwd)\s*[=:]\s*["\'][^"\']{8,}["\']""", r"""(secret|token|credential|auth)\s*[=:]\s*["\']?[A-Za-z0-9_\-]{16,}["\']?""", r"""(?-i)eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}""", r"""(?-i)gh[pousr]_[A-Za-z0-9]{36,}""", r"""(postgres|mysql|mongodb|redis)://[^:]+:[^@]+@""",
):
    _SECRETS = f"regexp_replace({_SECRETS}, '{_p.replace(chr(92) + chr(39), chr(39) * 2)}', '[REDACTED]', 'gi')"
QUERIES = {
    "snippets_of_targets": lambda s, d: snippets_at(_targets(s, d), _sc(s, d), table(s, d, "sources")).select("target", "line", F.md5("text").alias("text")),
    "context_bundle": lambda s, d: context_bundle(bound_symbols(s, d), call_edges(s, d), imports(s, d), "small_"),
    "project_compass_budget": lambda s, d: within_budget(compass(symbols(s, d, ["id", "kind", "file_path", "language", "visibility"]), table(s, d, "projects")).withColumn("o", F.when(F.col("section") == "language", 0).when(F.col("section") == "module", 1).otherwise(2)), ["o", F.desc("value"), "key"], 700).select("section", "key", "value"),
    "call_confidence_receiver": lambda s, d: call_confidence_by_receiver(_calls(s, d), _sc(s, d)),
    "callees_of_every_function": lambda s, d: call_edges(s, d).groupBy("caller_id").agg(F.count("*").alias("calls"), F.countDistinct("symbol_name").alias("names")),
    "references_by_file": lambda s, d: refs(s, d).groupBy("referenced_in_file", "reference_kind").agg(F.count("*").alias("n")),
}
_LEAD = "hit AS (SELECT *, row_number() OVER (ORDER BY name, id) AS rk FROM (SELECT * FROM bsym WHERE name ILIKE 'small%' ORDER BY name, id LIMIT 6)), lead_ AS (SELECT name AS lead_name, file_path AS lf FROM hit WHERE rk = 1)"
ORACLES = {
    "snippets_of_targets": _W + f", {_SRC}, best AS (SELECT path, arg_min((start_line, end_line), (end_line - start_line, start_line, end_line)) AS b FROM src JOIN sym ON sym.file_path = path AND 12 BETWEEN start_line AND end_line GROUP BY path), w AS (SELECT concat('sid:', id) AS target, file_path AS path, start_line AS a, end_line AS z FROM sym WHERE kind = 'struct' UNION ALL SELECT concat(src.path, ':12'), src.path, coalesce(b[1], 12), coalesce(b[2], 12) FROM (SELECT DISTINCT path FROM src) src LEFT JOIN best ON best.path = src.path), l AS (SELECT target, ls, unnest(range(greatest(a - 3, 1), least(least(z + 3, len(ls)), greatest(a - 3, 1) + 49) + 1)) AS line FROM w JOIN src USING (path)), q AS (SELECT target, line, ls[line] AS x FROM l) SELECT target, line::INT AS line, md5(concat(lpad(line::VARCHAR, greatest(4, length(line::VARCHAR))::INT, ' '), ' | ', {_SECRETS})) AS text FROM q",
    "context_bundle": f"WITH {EDGES_CTE}, {IMPORTS_CTE}, {_LEAD}, u AS (SELECT e.* FROM call_edges e JOIN lead_ ON symbol_name = lead_name ORDER BY referenced_in_file, line, column_num, caller_name LIMIT 10) SELECT 'card' AS part, name, file_path AS file, start_line AS line FROM hit WHERE rk <= 5 UNION ALL SELECT 'usage', caller_name, referenced_in_file, line FROM (SELECT *, row_number() OVER (PARTITION BY referenced_in_file ORDER BY line, column_num, caller_name) AS rn FROM u) WHERE rn <= 2 UNION ALL (SELECT DISTINCT 'callee', symbol_name, NULL, NULL::INT FROM call_edges JOIN lead_ ON caller_name = lead_name ORDER BY 2 LIMIT 5) UNION ALL (SELECT DISTINCT 'caller', caller_name, NULL, NULL::INT FROM call_edges JOIN lead_ ON symbol_name = lead_name ORDER BY 2 LIMIT 5) UNION ALL (SELECT DISTINCT 'importer', NULL, i.file_path, NULL::INT FROM imports i JOIN lead_ ON imported_path = lf ORDER BY 3 LIMIT 10) UNION ALL SELECT 'truncated', NULL, NULL, NULL::INT FROM (SELECT count(*) AS c FROM hit) WHERE c > 5",
    "call_confidence_receiver": _W + f", f AS (SELECT s.id, s.name, upper(p.name) AS pn, ascii(substr(s.id, 1, 1)) % 4 AS n FROM sym s LEFT JOIN sym p ON p.id = s.parent WHERE s.kind IN {_F}), c AS (SELECT id AS call_id, CASE WHEN n = 3 THEN concat(name, '_x') ELSE name END AS name, CASE WHEN n = 0 THEN substr(pn, 1, 6) WHEN n = 1 THEN 'nothing' END AS rt, n = 2 AS own, ascii(substr(id, 2, 1)) % 5 = 0 AS dyn FROM f), t AS (SELECT s.name, s.kind, lower(p.name) AS parent_name FROM sym s LEFT JOIN sym p ON p.id = s.parent WHERE s.kind IN {_F}), g AS (SELECT call_id, count(*) FILTER (t.kind IS NOT NULL AND (rt IS NULL OR coalesce(contains(parent_name, lower(rt)), FALSE)) AND (NOT own OR t.kind = 'method')) AS candidates, count(t.kind) AS named, bool_or(rt IS NOT NULL) AS typed, bool_or(dyn) AS dyn FROM c LEFT JOIN t ON t.name = c.name GROUP BY 1) SELECT call_id, candidates, CASE WHEN candidates = 1 AND NOT dyn THEN 'certain' ELSE 'possible' END AS confidence, CASE WHEN dyn THEN 'virtual_dispatch' WHEN candidates > 1 THEN 'multiple_candidates' WHEN candidates = 0 AND named > 0 AND typed THEN 'dynamic_receiver' WHEN candidates = 0 THEN 'external_library' END AS reason FROM g",
    "callees_of_every_function": f"WITH {EDGES_CTE} SELECT caller_id, count(*) AS calls, count(DISTINCT symbol_name) AS names FROM call_edges GROUP BY 1",
    "references_by_file": f"WITH {REFS_CTE} SELECT referenced_in_file, reference_kind, count(*) AS n FROM refs GROUP BY 1, 2",
}
