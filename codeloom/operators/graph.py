"""Call graphs, callers and callees, confidence, implementations, cross-language links, PageRank and project trees.

Edges come from one range join (an equi join on the file, then the innermost function around the line). Traversals are
frontier loops over DataFrames: a level joins the frontier's names with the edges and drops what was seen; each frontier
is written and read back, so the plan doesn't grow with the depth. Every level reads the edges: they should be a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.plans.index import BSYM_CTE, EDGES_CTE, FUNCTION_KINDS, IMPORTS_CTE, REFS_CTE, SYM, TYPE_KINDS, bound_symbols, call_edges, imports, inside, refs, symbols
from codeloom.sources.tables import latest, materialise, table

EDGE = ["caller_name", "symbol_name", "referenced_in_file", "line", "column_num"]
# Java types that stand for Kotlin types, and the Kotlin types that have none; any other has its own name.
KOTLIN_TO_JAVA = {"Int": "Integer", "Long": "Long", "Short": "Short", "Byte": "Byte", "Float": "Float", "Double": "Double", "Boolean": "Boolean", "Char": "Character", "Any": "Object"}
NO_JAVA_TYPE = ["Unit", "Nothing"]
# Folder names that stand for a layer.
LAYERS = ["api", "rest", "graphql", "grpc", "handlers", "controllers", "routes", "domain", "core", "models", "entities", "services", "infra", "infrastructure", "adapters", "repositories", "db", "database"]


def callers(edges: DataFrame, name: str, depth: int = 1) -> DataFrame:
    """Calls that reach `name` through at most `depth` calls, with the level at which each was first reached."""
    frontier = edges.sparkSession.createDataFrame([(name,)], "symbol_name string")
    seen = frontier.select(F.col("symbol_name").alias("name"))
    out = None
    for level in range(1, max(1, depth) + 1):
        hits = edges.join(F.broadcast(frontier) if level == 1 else frontier, "symbol_name", "left_semi").withColumn("depth", F.lit(level))
        out = hits if out is None else out.unionByName(hits)
        if level < depth:
            frontier = materialise(hits.select(F.col("caller_name").alias("symbol_name")).distinct().join(seen.withColumnRenamed("name", "symbol_name"), "symbol_name", "left_anti"))
            seen = seen.unionByName(frontier.select(F.col("symbol_name").alias("name")))
    return out


def callees(edges: DataFrame, df: DataFrame, name: str) -> DataFrame:
    """Calls in the span of the first definition of a function."""
    first = df.filter((F.col("name") == name) & F.col("kind").isin(FUNCTION_KINDS)).orderBy("file_path", "start_line", "id").limit(1)
    f = first.select(F.col("file_path").alias("referenced_in_file"), "start_line", "end_line")
    return edges.join(F.broadcast(f), "referenced_in_file").filter(F.col("line").between(F.col("start_line"), F.col("end_line")))


def call_graph(edges: DataFrame, df: DataFrame, entry: str, max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a breadth-first walk over names with a definition; a name's node is its first definition."""
    w = Window.partitionBy("name").orderBy("file_path", "start_line", "id")
    first = df.filter(F.col("kind").isin(FUNCTION_KINDS)).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("id", "name", "file_path", "start_line", "end_line")
    steps = edges.select("caller_id", "caller_name", "symbol_name").distinct().join(first.select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name")), ["caller_id", "caller_name"], "left_semi").select("caller_name", F.col("symbol_name").alias("callee_name")).distinct()
    steps = materialise(steps.join(first.select(F.col("name").alias("callee_name")), "callee_name", "left_semi"))
    frontier = first.filter(F.col("name") == entry).select("name", F.lit(0).alias("depth"))
    nodes = frontier
    found = None
    for level in range(1, max(1, max_depth) + 1):
        out = steps.join(frontier.select(F.col("name").alias("caller_name")), "caller_name", "left_semi").withColumn("depth", F.lit(level))
        found = out if found is None else found.unionByName(out)
        frontier = materialise(out.select(F.col("callee_name").alias("name")).distinct().join(nodes, "name", "left_anti").withColumn("depth", F.lit(level)))
        nodes = nodes.unionByName(frontier)
    return nodes.join(first, "name").select("id", "name", "file_path", "start_line", "depth"), found.select("caller_name", "callee_name", "depth")


def call_confidence(r: DataFrame, df: DataFrame) -> DataFrame:
    """Certain if one definition has the name, possible if several or none have; with the reason."""
    n = df.filter(F.col("kind").isin(FUNCTION_KINDS)).groupBy(F.col("name").alias("symbol_name")).agg(F.count("*").alias("candidates"))
    c = r.filter("reference_kind = 'call'").join(n, "symbol_name", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return c.select("symbol_name", "referenced_in_file", "line", "column_num", "candidates", F.when(F.col("candidates") == 1, "certain").otherwise("possible").alias("confidence"), F.when(F.col("candidates") > 1, "multiple_candidates").when(F.col("candidates") == 0, "external_library").alias("reason"))


def implementations(r: DataFrame, df: DataFrame) -> DataFrame:
    """Types whose span holds a reference that extends a trait: (trait, type id)."""
    t = df.filter(F.col("kind").isin("struct", "class", "enum")).select("id", F.col("name").alias("type_name"), F.col("file_path").alias("referenced_in_file"), "start_line", "end_line")
    traits = df.filter("kind = 'trait'").select(F.col("name").alias("symbol_name")).distinct()
    e = r.filter("reference_kind = 'extend'").join(traits, "symbol_name", "left_semi").select("symbol_name", "referenced_in_file", "line")
    return inside(e.distinct(), t, "referenced_in_file").select(F.col("symbol_name").alias("trait_name"), "id", "type_name").distinct()


def cross_language(df: DataFrame) -> DataFrame:
    """Types of one name in Java and in Kotlin."""
    t = df.filter(F.col("kind").isin(TYPE_KINDS))
    a, b = (t.filter(F.col("language") == x).select("name", F.col("id").alias(f"{x}_id")).distinct() for x in ("java", "kotlin"))
    return a.join(b, "name")


def kotlin_extensions(df: DataFrame) -> DataFrame:
    """Functions of Kotlin that extend a type: the receiver before the dot."""
    x = F.regexp_extract("signature", r"\bfun\s+(?:<[^>]*>\s*)?([A-Z]\w*)\.\w+\s*\(", 1)
    return df.filter((F.col("language") == "kotlin") & F.col("kind").isin(FUNCTION_KINDS)).withColumn("receiver", x).filter("receiver <> ''")


def mentions(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("signature").contains(name) & F.col("kind").isin(FUNCTION_KINDS))


def degrees(edges: DataFrame) -> DataFrame:
    o = edges.groupBy(F.col("caller_name").alias("name")).agg(F.count("*").alias("outgoing"))
    i = edges.groupBy(F.col("symbol_name").alias("name")).agg(F.count("*").alias("incoming"))
    return o.join(i, "name", "full").select("name", F.coalesce("incoming", F.lit(0)).alias("incoming"), F.coalesce("outgoing", F.lit(0)).alias("outgoing"))


def pagerank(edges: DataFrame, iterations: int = 3, damping: float = 0.85) -> DataFrame:
    """PageRank over distinct name pairs, with a fixed number of iterations; ranks without out-links are lost evenly."""
    e = materialise(edges.select(F.col("caller_name").alias("src"), F.col("symbol_name").alias("dst")).distinct())
    nodes = materialise(e.select(F.col("src").alias("name")).union(e.select("dst")).distinct())
    n = nodes.count()
    out = e.groupBy("src").agg(F.count("*").alias("k"))
    e = materialise(e.join(out, "src"))
    rank = nodes.withColumn("rank", F.lit(1.0) / n)
    for _ in range(iterations):
        got = e.join(rank.withColumnRenamed("name", "src"), "src").groupBy(F.col("dst").alias("name")).agg(F.sum(F.col("rank") / F.col("k")).alias("g"))
        rank = materialise(nodes.join(got, "name", "left").select("name", (F.lit((1 - damping) / max(1, n)) + damping * F.coalesce("g", F.lit(0.0))).alias("rank")))
    return rank


def git_recency(files: DataFrame) -> DataFrame:
    """A weight between 0 and 1 for how lately each file changed: halved every 90 days before the newest."""
    last = files.filter("path is not null").groupBy("path").agg(F.max("last_modified").alias("t"))
    newest = last.agg(F.max("t").alias("now"))
    return last.crossJoin(F.broadcast(newest)).select("path", F.round(F.pow(F.lit(0.5), (F.col("now") - F.col("t")) / (90 * 86400.0)), 6).alias("recency"))


def tree_roots(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")


def tree_children(nodes: DataFrame) -> DataFrame:
    return nodes.filter("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n_children"), F.array_join(F.array_sort(F.collect_list("id")), "|").alias("children"))


def node_type(nodes: DataFrame) -> DataFrame:
    p = F.lower("path")
    return nodes.select("id", F.when(F.lower("name").isin(LAYERS), "layer").when(p.contains("src/") | p.startswith("src"), "module").when(p.contains("packages/") | p.contains("crates/"), "package").otherwise("directory").alias("inferred_type"))


def module_of(path):
    return F.array_join(F.slice(F.split(path, "/"), 1, 2), "/")


def module_dependents(i: DataFrame) -> DataFrame:
    """Which modules import from each module (the first two steps of a path)."""
    return i.select(module_of(F.col("imported_path")).alias("module"), module_of(F.col("file_path")).alias("dependent")).filter("module <> dependent").distinct()


def _nodes(s, d):
    return latest(table(s, d, "project_nodes"), "id", "updated_at", ["id", "updated_at", "parent_id", "node_type", "name", "path"])


def _sig(s, d):
    return symbols(s, d, ["id", "name", "kind", "language", "signature"])


_EXT = """SELECT concat('k', cast(p_partkey AS varchar(20))) AS id, concat('f', cast(p_partkey AS varchar(20))) AS name, CASE p_partkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'method' ELSE 'class' END AS kind, 'kotlin' AS language,
 concat(CASE p_partkey % 5 WHEN 0 THEN 'fun String.' WHEN 1 THEN 'inline fun <T> List.' WHEN 2 THEN 'fun ' WHEN 3 THEN 'fun lower.' ELSE 'val x.' END, 'f', cast(p_partkey AS varchar(20)), '(a: Int): T') AS signature FROM {part}"""
_E, _R, _B = f"WITH {EDGES_CTE} ", f"WITH {REFS_CTE} ", f"WITH {BSYM_CTE} "
_NODES = "n AS (SELECT id, parent_id, name, path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM project_nodes WHERE id IS NOT NULL) WHERE rn = 1)"
_T = "('" + "','".join(TYPE_KINDS) + "')"
_LEVEL1 = ", l1 AS (SELECT *, 1 AS depth FROM call_edges WHERE symbol_name = 'small_ring')"
_LEVEL2 = _LEVEL1 + ", f2 AS (SELECT DISTINCT caller_name AS n FROM l1 WHERE caller_name <> 'small_ring'), l2 AS (SELECT *, 2 AS depth FROM call_edges WHERE symbol_name IN (SELECT n FROM f2))"
_LEVEL3 = _LEVEL2 + ", f3 AS (SELECT DISTINCT caller_name AS n FROM l2 WHERE caller_name <> 'small_ring' AND caller_name NOT IN (SELECT n FROM f2)), l3 AS (SELECT *, 3 AS depth FROM call_edges WHERE symbol_name IN (SELECT n FROM f3))"
_C = "SELECT caller_name, symbol_name, referenced_in_file, line, column_num, depth FROM "
_BFS = _E + """, first AS (SELECT id, name, file_path, start_line, end_line FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file_path, start_line, id) AS rn FROM bsym WHERE kind IN ('function','method')) WHERE rn = 1),
st AS (SELECT DISTINCT caller_name, symbol_name AS callee_name FROM call_edges e JOIN first f ON f.id = e.caller_id WHERE symbol_name IN (SELECT name FROM first)),
n0 AS (SELECT name, 0 AS depth FROM first WHERE name = 'small_ring'),
n1 AS (SELECT DISTINCT callee_name AS name, 1 AS depth FROM st WHERE caller_name IN (SELECT name FROM n0) AND callee_name NOT IN (SELECT name FROM n0)),
n2 AS (SELECT DISTINCT callee_name AS name, 2 AS depth FROM st WHERE caller_name IN (SELECT name FROM n1) AND callee_name NOT IN (SELECT name FROM n0 UNION ALL SELECT name FROM n1)) """
_RANK = ", e AS (SELECT DISTINCT caller_name AS src, symbol_name AS dst FROM call_edges), nd AS (SELECT src AS name FROM e UNION SELECT dst FROM e), k AS (SELECT src, count(*) AS k FROM e GROUP BY 1), r0 AS (SELECT name, 1.0::DOUBLE / (SELECT count(*) FROM nd) AS rank FROM nd)"
for _i in (1, 2, 3):
    _RANK += f", r{_i} AS (SELECT nd.name, 0.15::DOUBLE / (SELECT count(*) FROM nd) + 0.85::DOUBLE * coalesce(g, 0) AS rank FROM nd LEFT JOIN (SELECT dst, sum(rank / k) AS g FROM e JOIN k USING (src) JOIN r{_i - 1} ON r{_i - 1}.name = e.src GROUP BY 1) x ON x.dst = nd.name)"
QUERIES = {
    "call_edges": lambda s, d: call_edges(s, d).select("caller_id", *EDGE),
    "find_callers_d1": lambda s, d: callers(call_edges(s, d), "small_ring", 1).select(*EDGE, "depth"),
    "find_callers_d2": lambda s, d: callers(call_edges(s, d), "small_ring", 2).select(*EDGE, "depth"),
    "find_callers_d3": lambda s, d: callers(call_edges(s, d), "small_ring", 3).select(*EDGE, "depth"),
    "find_callees": lambda s, d: callees(call_edges(s, d), bound_symbols(s, d), "small_ring").select(*EDGE),
    "call_graph_bfs_nodes": lambda s, d: call_graph(call_edges(s, d), bound_symbols(s, d), "small_ring", 2)[0],
    "call_graph_bfs_edges": lambda s, d: call_graph(call_edges(s, d), bound_symbols(s, d), "small_ring", 2)[1],
    "call_confidence": lambda s, d: call_confidence(refs(s, d), bound_symbols(s, d)),
    "implementations": lambda s, d: implementations(refs(s, d), bound_symbols(s, d)),
    "cross_language_refs": lambda s, d: cross_language(symbols(s, d, ["id", "name", "kind", "language"])),
    "kotlin_extensions": lambda s, d: kotlin_extensions(_sig(s, d)).select("id", "name", "receiver"),
    "kotlin_extensions_planted": lambda s, d: kotlin_extensions(s.sql(_EXT, part=table(s, d, "part"))).select("id", "name", "receiver"),
    "signature_mentions": lambda s, d: mentions(_sig(s, d), "label").select("id", "name"),
    "in_out_degree": lambda s, d: degrees(call_edges(s, d)),
    "pagerank_3": lambda s, d: pagerank(call_edges(s, d), 3).select("name", F.round("rank", 6).alias("rank")),
    "git_recency": lambda s, d: git_recency(table(s, d, "files")),
    "project_tree_roots": lambda s, d: tree_roots(_nodes(s, d)).select("id", "name", "path"),
    "project_tree_children": lambda s, d: tree_children(_nodes(s, d)),
    "node_type_inference": lambda s, d: node_type(_nodes(s, d)),
    "module_dependents": lambda s, d: module_dependents(imports(s, d)),
}
ORACLES = {
    "call_edges": _E + "SELECT * FROM call_edges",
    "find_callers_d1": _E + _LEVEL1 + _C + "l1",
    "find_callers_d2": _E + _LEVEL2 + _C + "l1 UNION ALL " + _C + "l2",
    "find_callers_d3": _E + _LEVEL3 + _C + "l1 UNION ALL " + _C + "l2 UNION ALL " + _C + "l3",
    "find_callees": _E + ", f AS (SELECT * FROM bsym WHERE name = 'small_ring' AND kind IN ('function','method') ORDER BY file_path, start_line, id LIMIT 1) SELECT e.caller_name, e.symbol_name, e.referenced_in_file, e.line, e.column_num FROM call_edges e JOIN f ON f.file_path = e.referenced_in_file AND e.line BETWEEN f.start_line AND f.end_line",
    "call_graph_bfs_nodes": _BFS + "SELECT f.id, f.name, f.file_path, f.start_line, n.depth FROM (SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2) n JOIN first f USING (name)",
    "call_graph_bfs_edges": _BFS + "SELECT caller_name, callee_name, 1 AS depth FROM st WHERE caller_name IN (SELECT name FROM n0) UNION ALL SELECT caller_name, callee_name, 2 FROM st WHERE caller_name IN (SELECT name FROM n1)",
    "call_confidence": _R + "SELECT symbol_name, referenced_in_file, line, column_num, coalesce(c, 0) AS candidates, CASE WHEN c = 1 THEN 'certain' ELSE 'possible' END AS confidence, CASE WHEN c > 1 THEN 'multiple_candidates' WHEN c IS NULL THEN 'external_library' END AS reason FROM refs LEFT JOIN (SELECT name, count(*) AS c FROM bsym WHERE kind IN ('function','method') GROUP BY 1) b ON b.name = symbol_name WHERE reference_kind = 'call'",
    "implementations": _R + "SELECT DISTINCT r.symbol_name AS trait_name, t.id, t.name AS type_name FROM refs r JOIN bsym t ON t.file_path = r.referenced_in_file AND t.kind IN ('struct','class','enum') AND r.line BETWEEN t.start_line AND t.end_line WHERE r.reference_kind = 'extend' AND r.symbol_name IN (SELECT name FROM bsym WHERE kind = 'trait')",
    "cross_language_refs": f"WITH {SYM} SELECT DISTINCT a.name, a.id AS java_id, b.id AS kotlin_id FROM sym a JOIN sym b ON a.name = b.name AND a.language = 'java' AND b.language = 'kotlin' WHERE a.kind IN {_T} AND b.kind IN {_T}",
    "kotlin_extensions": f"WITH {SYM} SELECT id, name, receiver FROM (SELECT *, regexp_extract(signature, '\\bfun\\s+(?:<[^>]*>\\s*)?([A-Z]\\w*)\\.\\w+\\s*\\(', 1) AS receiver FROM sym WHERE language = 'kotlin' AND kind IN ('function','method')) WHERE receiver <> ''",
    "kotlin_extensions_planted": "SELECT id, name, CASE n WHEN 0 THEN 'String' WHEN 1 THEN 'List' END AS receiver FROM (SELECT concat('k', p_partkey) AS id, concat('f', p_partkey) AS name, p_partkey % 5 AS n FROM part WHERE p_partkey % 3 < 2) WHERE n < 2",
    "signature_mentions": f"WITH {SYM} SELECT id, name FROM sym WHERE contains(signature, 'label') AND kind IN ('function','method')",
    "in_out_degree": _E + "SELECT coalesce(o.n, i.n) AS name, coalesce(i.c, 0) AS incoming, coalesce(o.c, 0) AS outgoing FROM (SELECT caller_name AS n, count(*) AS c FROM call_edges GROUP BY 1) o FULL JOIN (SELECT symbol_name AS n, count(*) AS c FROM call_edges GROUP BY 1) i ON i.n = o.n",
    "pagerank_3": _E + _RANK + " SELECT name, round(rank, 6) AS rank FROM r3",
    "git_recency": "WITH l AS (SELECT path, max(last_modified) AS t FROM files WHERE path IS NOT NULL GROUP BY 1) SELECT path, round(power(0.5::DOUBLE, ((SELECT max(t) FROM l) - t) / 7776000.0::DOUBLE), 6) AS recency FROM l",
    "project_tree_roots": f"WITH {_NODES} SELECT id, name, path FROM n WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM n)",
    "project_tree_children": f"WITH {_NODES} SELECT parent_id, count(*) AS n_children, string_agg(id, '|' ORDER BY id) AS children FROM n WHERE parent_id IS NOT NULL GROUP BY 1",
    "node_type_inference": f"WITH {_NODES} SELECT id, CASE WHEN lower(name) IN ('api', 'rest', 'graphql', 'grpc', 'handlers', 'controllers', 'routes', 'domain', 'core', 'models', 'entities', 'services', 'infra', 'infrastructure', 'adapters', 'repositories', 'db', 'database') THEN 'layer' WHEN contains(lower(path), 'src/') OR starts_with(lower(path), 'src') THEN 'module' WHEN contains(lower(path), 'packages/') OR contains(lower(path), 'crates/') THEN 'package' ELSE 'directory' END AS inferred_type FROM n",
    "module_dependents": f"WITH {IMPORTS_CTE} SELECT DISTINCT array_to_string(string_split(imported_path, '/')[1:2], '/') AS module, array_to_string(string_split(file_path, '/')[1:2], '/') AS dependent FROM imports",
}
