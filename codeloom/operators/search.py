"""Search over the index: inverted index with BM25, prefix and typo-tolerant search, weighted ranking, pages,
diversification, overlays, tag filters and a federated query.

The token table is the index: one row per (document, token) with its frequency, from one pass over the texts. A query
touches the rows of its tokens only; document frequencies and the mean length are aggregations of the same table. Ranked
results end in the id, and top-k is Spark's own (no full sort).
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.graph import git_recency
from codeloom.operators.lookup import OUT
from codeloom.operators.stats import directory
from codeloom.operators.tags import files_with_tags, with_all_tags
from codeloom.plans.index import BSYM_CTE, EDGES_CTE, FUNCTION_KINDS, SYM, TAGS_CTE, TYPE_KINDS, bound_symbols, call_edges, file_tags, stored, symbols
from codeloom.sources.tables import table

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
# Weights of the ranking and of visibilities.
WEIGHTS = {"name": 0.4, "visibility": 0.2, "pagerank": 0.2, "recency": 0.1, "locality": 0.1}
VISIBILITY = {"public": 1.0, "internal": 0.7, "protected": 0.5, "private": 0.3}
# Frameworks as (name, searched word, category, evidence).
FRAMEWORKS = [
    ("actix", "actix_web", "web", "import of actix_web"), ("axum", "axum", "web", "import of axum"), ("rocket", "rocket", "web", "import of rocket"), ("warp", "warp", "web", "import of warp"), ("tokio", "tokio", "async runtime", "import of tokio"),
    ("clap", "clap", "cli", "import of clap"), ("serde", "serde", "serialization", "import of serde"), ("React", "React", "web", "import of React"), ("Vue", "Vue", "web", "import of Vue"), ("Angular", "angular", "web", "import of angular"),
    ("Express", "express", "web", "import of express"), ("Next.js", "next", "web", "import of next"), ("Jest", "jest", "testing", "import of jest"), ("Mocha", "mocha", "testing", "import of mocha"), ("Django", "django", "web", "import of django"),
    ("Flask", "flask", "web", "import of flask"), ("FastAPI", "fastapi", "web", "import of fastapi"), ("pytest", "pytest", "testing", "import of pytest"), ("Spring", "springframework", "web", "import of spring"),
    ("Spring Boot", "SpringBootApplication", "web", "SpringBootApplication annotation"), ("JUnit", "junit", "testing", "import of junit"),
]
# Entry points as (type, priority, words of which one must be found, with the evidence of each, words of which the name must hold one, of which the path must hold one).
ENTRIES = [
    ("main", 0, [("main", "fn main() in main file")], [], ["main.", "/Main.java", "/Main.kt"]),
    ("tokio_main", 0, [("tokio_main", "#[tokio::main] attribute")], [], []),
    ("actix_main", 0, [("actix_web_main", "#[actix_web::main] attribute")], [], []),
    ("server", 1, [("listen", "server.listen() call"), ("serve", "serve() call"), ("bind", "server.bind() call"), ("run_server", "run_server function"), ("start_server", "start_server function")], ["server", "listen"], []),
    ("cli", 2, [("command", "CLI command handler"), ("subcommand", "CLI subcommand handler"), ("execute", "execute command"), ("run_cli", "CLI runner")], [], ["cli", "command", "cmd"]),
    ("rest_endpoint", 3, [("get_", "GET endpoint"), ("post_", "POST endpoint"), ("put_", "PUT endpoint"), ("delete_", "DELETE endpoint"), ("patch_", "PATCH endpoint"), ("handler", "request handler")], [], ["api", "handler", "route", "controller"]),
]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def token_table(df: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """((key, token, tf), (key, length)) over several columns of equal weight."""
    t = df.select(key, F.concat(*[F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")) for c in columns]).alias("t"))
    return t.select(key, F.explode("t").alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf")), t.select(key, F.size("t").alias("length"))


def query_tokens(query: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+|_", re.sub(r"[*\"']", "", query).lower()) if t]


def bm25(df: DataFrame, key: str, columns: list[str], query: str, limit: int = 100) -> DataFrame:
    """(key, score): all tokens must occur, the last as a prefix; blank queries find nothing."""
    return bm25_indexed(*token_table(df, key, columns), key, query, limit)


def token_index(spark, sf_dir: str, name: str, build, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The token table of a search corpus and its lengths, stored: sorted by token, so a query reads its tokens' row groups."""
    pair: list = []

    def both(i: int) -> DataFrame:
        if not pair:
            pair.extend(token_table(build(), key, columns))
        return pair[i]

    return stored(spark, sf_dir, f"tokens of {name}", lambda: both(0), ["token"]), stored(spark, sf_dir, f"lengths of {name}", lambda: both(1), [key])


def bm25_indexed(tf: DataFrame, length: DataFrame, key: str, query: str, limit: int = 100) -> DataFrame:
    """The same over a token table (key, token, tf) and the lengths (key, length). Filters on the token come first: equality
    and a prefix, both readable from Parquet's statistics."""
    q = query_tokens(query)
    if not q:
        return length.select(key, F.lit(0.0).alias("score")).limit(0)
    phrase = F.when(F.col("token").startswith(q[-1]), len(q) - 1)
    for i, t in enumerate(q[:-1]):
        phrase = F.when(F.col("token") == t, i).otherwise(phrase)
    asked = F.col("token").startswith(q[-1])
    for t in q[:-1]:
        asked = asked | (F.col("token") == t)
    hit = tf.filter(asked).withColumn("phrase", phrase).groupBy(key, "phrase").agg(F.sum("tf").alias("tf"))
    n = hit.groupBy("phrase").agg(F.count("*").alias("n"))  # a row per token of the query
    stats = length.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    idf = F.greatest(F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(IDF_FLOOR))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = hit.join(F.broadcast(n), "phrase").join(length, key).crossJoin(F.broadcast(stats)).groupBy(key).agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("k")).filter(F.col("k") == len(q))
    return scored.select(key, "score").orderBy(F.desc("score"), key).limit(limit)


def prefix_search(df: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Short queries: names that begin with it, cut by name, then scored."""
    q = re.sub("[%_]", "", query)
    n = F.lower("name")
    return df.filter(F.col("name").ilike(f"{q}%")).orderBy("name", "id").limit(limit).withColumn("score", F.when(n == q.lower(), 1.0).when(n.startswith(q.lower()), 0.8).otherwise(0.5))


def jaro_winkler(a: str, b: str) -> float:
    """Similarity with the floored number of transpositions, a prefix of up to 4 and a boost above 0.7."""
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    window = max(0, max(la, lb) // 2 - 1)
    fb, ma = [False] * lb, []
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(lb, i + window + 1)):
            if not fb[j] and b[j] == c:
                fb[j] = True
                ma.append(c)
                break
    m = len(ma)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(ma, (b[j] for j in range(lb) if fb[j]), strict=True)) // 2
    jaro = (m / la + m / lb + (m - t) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, la, lb))
    return jaro + 0.1 * prefix * (1 - jaro)


def similarity_to(query: str):
    @F.pandas_udf("double")
    def score(names: pd.Series) -> pd.Series:
        known: dict[str, float] = {}
        return names.map(lambda x: known[x] if x in known else known.setdefault(x, jaro_winkler(x, query)) if x is not None else np.nan)

    return score


def fuzzy(df: DataFrame, query: str, threshold: float = 0.7, limit: int = 20) -> DataFrame:
    """Typo-tolerant: candidates share the first 3 signs, signs 2-3 after any first, or hold the first 4; only these
    reach the Python function, and each distinct name once."""
    q = query.lower()
    n = F.lower("name")
    names = df.filter(n.like(f"{q[:3]}%") | n.like(f"_{q[1:3]}%") | n.contains(q[:4])).select("name").distinct()
    scored = names.withColumn("score", F.round(similarity_to(q)(F.lower("name")), 6)).filter(F.col("score") >= threshold)
    return df.join(scored, "name").orderBy(F.desc("score"), "name", "id").limit(limit)


def weighted(df: DataFrame, score: Column, file: str | None = None, pagerank: Column | None = None, recency: Column | None = None) -> Column:
    """The combined rank of a hit from its text score, visibility, metrics and nearness to the current file."""
    v = F.lit(0.5)
    for name, x in VISIBILITY.items():
        v = F.when(F.col("visibility") == name, x).otherwise(v)
    clamp = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    near = F.lit(0.0) if file is None else F.when(F.col("file_path") == file, 1.0).when(directory(F.col("file_path")) == file.rsplit("/", 1)[0], 0.5).otherwise(0.0)
    return F.round(WEIGHTS["name"] * clamp(score) + WEIGHTS["visibility"] * v + WEIGHTS["pagerank"] * clamp(F.lit(0.0) if pagerank is None else pagerank) + WEIGHTS["recency"] * clamp(F.lit(0.0) if recency is None else recency) + WEIGHTS["locality"] * near, 6)


def advanced(df: DataFrame, query: str, limit: int = 20, file: str | None = None, index: tuple[DataFrame, DataFrame] | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """Three times as many text hits as wanted, ranked again by weight; `metrics` is (id, pagerank, recency), 0 if missing."""
    tf, length = index or token_table(df, "id", ["name", "signature", "doc_comment"])
    hits = bm25_indexed(tf, length, "id", query, 3 * limit)  # 3 * limit rows
    d = df.join(F.broadcast(hits), "id")
    d = d.join(metrics, "id", "left") if metrics is not None else d.withColumns({"pagerank": F.lit(0.0), "recency": F.lit(0.0)})
    return d.withColumn("rank_score", weighted(d, F.col("score") / 10, file, F.col("pagerank"), F.col("recency"))).orderBy(F.desc("rank_score"), "id").limit(limit)


KEYS = ["kind", "file_path", "start_line", "id"]


def keyset_page(df: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """The page after the last row's (score, kind, file_path, start_line, id), in that order, the score descending."""
    if after is not None:
        later, same = F.lit(False), F.col("score") == after[0]
        for c, v in zip(KEYS, after[1:], strict=True):
            later, same = later | (same & (F.col(c) > v)), same & (F.col(c) == v)
        df = df.filter((F.col("score") < after[0]) | later)
    return df.orderBy(F.desc("score"), *KEYS).limit(size)


def offset_page(df: DataFrame, offset: int, size: int) -> DataFrame:
    return df.orderBy(F.desc("score"), *KEYS).offset(offset).limit(size)


def diversify(df: DataFrame, per: Column, n: int, order: list) -> DataFrame:
    """At most n rows per group, in rank order."""
    return df.withColumn("_per", per).withColumn("_rn", F.row_number().over(Window.partitionBy("_per").orderBy(*order))).filter(F.col("_rn") <= n).drop("_per", "_rn")


def contains_score(q: str) -> Column:
    n = F.lower("name")
    return F.when(n == q, 1.0).when(n.startswith(q), 0.9).otherwise(0.7)


def overlay_search(base: DataFrame, overlay: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Unsaved documents first, then the index without any path of the overlay."""
    q = query.lower()
    hit = lambda d, o: d.filter(F.lower("name").contains(q)).select(*OUT, F.lit(o).alias("origin"), contains_score(q).alias("score"))
    rest = base.join(overlay.select("file_path").distinct(), "file_path", "left_anti")
    return hit(overlay, 0).unionByName(hit(rest, 1)).orderBy("origin", F.desc("score"), "file_path", "start_line", "id").limit(limit)


def found(t: Column, query: str) -> Column:
    """Whether an array of tokens answers a query: it has all of its words, the last as a prefix."""
    q = query_tokens(query)
    hit = F.exists(t, lambda x: x.startswith(q[-1]))
    for w in q[:-1]:
        hit = F.array_contains(t, w) & hit
    return hit


def searched(df: DataFrame) -> DataFrame:
    """Adds t: the tokens of name, signature and doc comment."""
    return df.withColumn("t", F.concat(*[F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")) for c in ("name", "signature", "doc_comment")]))


def entry_points(df: DataFrame) -> DataFrame:
    """(id, name, file_path, start_line, priority, entry_type, evidence): functions that one of the detectors takes for an
    entry point; of several in one line of a file, and of several detectors, the one of the highest priority."""
    any_of = lambda c, words: F.lit(not words) if not words else functools.reduce(lambda a, b: a | b, [c.contains(w) for w in words])
    d = searched(df.filter(F.col("kind") == "function"))
    rule = None
    for kind, priority, words, names, paths in ENTRIES:
        test = any_of(F.col("name"), names) & any_of(F.col("file_path"), paths) & (F.col("name") == "main" if kind == "main" else F.lit(True))
        for w, evidence in words:
            hit, e = test & found(F.col("t"), w), F.struct(F.lit(priority).alias("priority"), F.lit(kind).alias("entry_type"), F.lit(evidence).alias("evidence"))
            rule = F.when(hit, e) if rule is None else rule.when(hit, e)
    d = d.withColumn("e", rule).filter("e is not null").select("id", "name", "file_path", "start_line", "e.*")
    return diversify(d, F.struct("file_path", "start_line"), 1, ["priority", "id"])


def frameworks(df: DataFrame) -> DataFrame:
    """(name, category, evidence) of the frameworks whose word some symbol's name, signature or comment has: one pass over
    the symbols, in which each partition keeps one bit for each framework."""
    t = searched(df).agg(*[F.coalesce(F.bool_or(found(F.col("t"), w)), F.lit(False)).alias(name.replace(".", "_")) for name, w, _, _ in FRAMEWORKS])
    each = F.array(*[F.when(F.col(f"`{n.replace('.', '_')}`"), F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.lit(e).alias("evidence"))) for n, _, c, e in FRAMEWORKS])
    return t.select(F.explode(F.array_compact(each)).alias("f")).select("f.*")


def compass(df: DataFrame, nodes: DataFrame, documents: DataFrame, query: str) -> DataFrame:
    """One ranked list out of at most 4 symbols, 2 modules and 1 document heading."""
    q = query.lower()
    s = bm25(df, "id", ["name", "signature"], query, 4).select(F.lit("symbol").alias("result_type"), F.col("id").alias("key"), "score")
    m = nodes.filter(F.lower("name").contains(q)).select(F.lit("module").alias("result_type"), F.col("id").alias("key"), F.lit(0.8).alias("score")).distinct().orderBy("key").limit(2)
    h = documents.filter(F.lower("text").rlike(r"(?m)^#{1,6}[ ].*" + re.escape(q))).select(F.lit("doc").alias("result_type"), F.col("doc_id").cast("string").alias("key"), F.lit(0.7).alias("score")).orderBy(F.col("key").cast("long")).limit(1)
    return s.unionByName(m).unionByName(h).orderBy(F.desc("score"), "result_type", "key").limit(10)


def context_bundle(df: DataFrame, edges: DataFrame, query: str, cards: int = 5, usages: int = 10, per_file: int = 2) -> DataFrame:
    """Cards of the best prefix hits, and of their usages at most some in all and few per file."""
    hit = prefix_search(df, query, cards).select("name", "id", "file_path", "start_line")
    card = hit.select(F.lit("card").alias("part"), "name", F.col("file_path").alias("file"), F.col("start_line").alias("line"))
    u = edges.join(hit.select(F.col("name").alias("symbol_name")).distinct(), "symbol_name", "left_semi").orderBy("referenced_in_file", "line", "column_num", "symbol_name").limit(usages)
    use = diversify(u, F.col("referenced_in_file"), per_file, ["line", "column_num", "symbol_name"]).select(F.lit("usage").alias("part"), F.col("symbol_name").alias("name"), F.col("referenced_in_file").alias("file"), "line")
    return card.unionByName(use)


def _s(s, d, *extra):
    return symbols(s, d, list(dict.fromkeys([*OUT, *extra])))


def _tokens(s, d):
    return token_index(s, d, "symbols", lambda: _s(s, d, "signature", "doc_comment"), "id", ["name", "signature", "doc_comment"])


def _metrics(s, d):
    """Ranks by how many symbols a parent holds, and the recency of each symbol's file."""
    x = symbols(s, d, ["id", "parent", "file_path"])
    held = x.groupBy(F.col("parent").alias("id")).agg((F.count("*") / 10.0).alias("pagerank"))
    return x.join(held, "id", "left").join(git_recency(table(s, d, "files")).withColumnRenamed("path", "file_path"), "file_path", "left").select("id", "pagerank", "recency")


NEAR = "fjord-node/manifestkit-8/app/services/graph_tag.java"


def _scored(s, d):
    return bound_symbols(s, d).filter(F.lower("name").contains("ring")).withColumn("score", contains_score("small_ring"))


def _overlay(s, d):
    """Unsaved versions of some files: the same symbols, moved."""
    b = bound_symbols(s, d).filter(F.col("file_path").like("%brand_12/%"))
    return b.withColumn("start_line", F.col("start_line") + 1000).withColumn("end_line", F.col("end_line") + 1000).withColumn("id", F.concat(F.lit("o"), "id"))


def _by_tag(s, d):
    ok = with_all_tags(file_tags(s, d), [("domain", "auth"), (None, "service")])
    return bound_symbols(s, d).join(ok, "file_path", "left_semi").filter(F.lower("name").contains("ring")).orderBy("file_path", "start_line", "id").limit(50)


def _with_meta(s, d):
    return _by_tag(s, d).join(files_with_tags(file_tags(s, d)), "file_path", "left").select("id", "name", "file_path", "tags")


_AFTER = (0.9, "enum", "src/brand_22/m1.rs", 1, "")
_O = ", ".join(OUT)
_W = f"WITH {SYM} "


def _bm25_sql(cte: str, key: str, source: str, columns: list[str], query: str, limit: int) -> str:
    q = query_tokens(query)
    text = " || ".join(f"coalesce(list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), []::VARCHAR[])" for c in columns)
    phrase = "CASE " + " ".join(f"WHEN token = '{t}' THEN {i}" for i, t in enumerate(q[:-1])) + f" WHEN starts_with(token, '{q[-1]}') THEN {len(q) - 1} END"
    return f"""{cte}, doc AS (SELECT {key} AS k, {text} AS t FROM {source}), len AS (SELECT k, len(t) AS length FROM doc), hit AS (SELECT k, phrase, count(*) AS tf FROM (SELECT k, {phrase} AS phrase FROM (SELECT k, unnest(t) AS token FROM doc)) WHERE phrase IS NOT NULL GROUP BY 1, 2), n AS (SELECT phrase, count(*) AS n FROM hit GROUP BY 1), st AS (SELECT count(*) AS docs, avg(length) AS mean FROM len),
sc AS (SELECT k, round(sum(greatest(ln((docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score, count(*) AS c FROM hit JOIN n USING (phrase) JOIN len USING (k) CROSS JOIN st GROUP BY 1), best AS (SELECT k AS {key}, score FROM sc WHERE c = {len(q)} ORDER BY score DESC, k LIMIT {limit}) """


_VIS = "CASE visibility " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in VISIBILITY.items()) + " ELSE 0.5 END"
_RING = BSYM_CTE + ", sc AS (SELECT *, CASE WHEN lower(name) = 'small_ring' THEN 1.0 WHEN starts_with(lower(name), 'small_ring') THEN 0.9 ELSE 0.7 END::DOUBLE AS score FROM bsym WHERE contains(lower(name), 'ring'))"
_OV = BSYM_CTE + ", ov AS (SELECT concat('o', id) AS id, name, kind, file_path, start_line + 1000 AS start_line, end_line + 1000 AS end_line FROM bsym WHERE file_path LIKE '%brand_12/%')"
_TAGGED = f"WITH {BSYM_CTE}, {TAGS_CTE}, ok AS (SELECT DISTINCT file_path FROM file_tags WHERE category = 'domain' AND tag = 'auth' AND file_path IN (SELECT file_path FROM file_tags WHERE tag = 'service')), hit AS (SELECT * FROM bsym WHERE file_path IN (SELECT file_path FROM ok) AND contains(lower(name), 'ring') ORDER BY file_path, start_line, id LIMIT 50)"
_TOK = "list_filter(string_split_regex(lower(concat_ws(' ', name, signature, doc_comment)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_HAS = lambda words: "(" + " OR ".join(f"len(list_filter(t, lambda x: starts_with(x, '{q[-1]}'))) > 0" + "".join(f" AND list_contains(t, '{w}')" for w in q[:-1]) for q in map(query_tokens, words)) + ")"
_ENTRY = f"""CASE WHEN name = 'main' AND {_HAS(['main'])} AND (contains(file_path, 'main.') OR contains(file_path, '/Main.java') OR contains(file_path, '/Main.kt')) THEN 'main' WHEN {_HAS(['tokio_main'])} THEN 'tokio_main' WHEN {_HAS(['actix_web_main'])} THEN 'actix_main'
 WHEN (contains(name, 'server') OR contains(name, 'listen')) AND {_HAS(['listen', 'serve', 'bind', 'run_server', 'start_server'])} THEN 'server'
 WHEN regexp_matches(file_path, 'cli|command|cmd') AND {_HAS(['command', 'subcommand', 'execute', 'run_cli'])} THEN 'cli'
 WHEN regexp_matches(file_path, 'api|handler|route|controller') AND {_HAS(['get_', 'post_', 'put_', 'delete_', 'patch_', 'handler'])} THEN 'rest_endpoint' END"""
_EVIDENCE = f"""CASE entry_type WHEN 'main' THEN 'fn main() in main file' WHEN 'tokio_main' THEN '#[tokio::main] attribute' WHEN 'actix_main' THEN '#[actix_web::main] attribute'
 WHEN 'server' THEN CASE WHEN {_HAS(['listen'])} THEN 'server.listen() call' WHEN {_HAS(['serve'])} THEN 'serve() call' WHEN {_HAS(['bind'])} THEN 'server.bind() call' WHEN {_HAS(['run_server'])} THEN 'run_server function' ELSE 'start_server function' END
 WHEN 'cli' THEN CASE WHEN {_HAS(['command'])} THEN 'CLI command handler' WHEN {_HAS(['subcommand'])} THEN 'CLI subcommand handler' WHEN {_HAS(['execute'])} THEN 'execute command' ELSE 'CLI runner' END
 ELSE CASE WHEN {_HAS(['get_'])} THEN 'GET endpoint' WHEN {_HAS(['post_'])} THEN 'POST endpoint' WHEN {_HAS(['put_'])} THEN 'PUT endpoint' WHEN {_HAS(['delete_'])} THEN 'DELETE endpoint' WHEN {_HAS(['patch_'])} THEN 'PATCH endpoint' ELSE 'request handler' END END"""
_PLANT = """SELECT concat('e', cast(p_partkey AS varchar(20))) AS id, CASE p_partkey % 9 WHEN 0 THEN 'main' WHEN 1 THEN 'run_server' WHEN 2 THEN 'listener' WHEN 3 THEN 'execute_all' WHEN 4 THEN 'get_user' WHEN 5 THEN 'delete_user' WHEN 6 THEN 'tokio_main' WHEN 7 THEN 'bind_server' ELSE 'plain' END AS name,
 CASE p_partkey % 10 WHEN 9 THEN 'method' ELSE 'function' END AS kind, concat(CASE p_partkey % 5 WHEN 0 THEN 'src/cli/' WHEN 1 THEN 'src/api/' WHEN 2 THEN 'src/' WHEN 3 THEN 'cmd/' ELSE 'lib/routes/' END, 'f', cast(p_partkey % 300 AS varchar(20)), '/', CASE p_partkey % 4 WHEN 0 THEN 'main.rs' WHEN 1 THEN 'Main.kt' ELSE 'other.py' END) AS file_path,
 cast(p_partkey % 3 AS int) AS start_line, 0 AS end_line, CASE p_partkey % 6 WHEN 0 THEN 'use actix_web::HttpServer' WHEN 1 THEN 'fn x(a: ReactNode)' ELSE NULL END AS signature, CASE p_partkey % 7 WHEN 0 THEN 'A web of the actix kind; request handler, pytest-like. Next, start server.' ELSE NULL END AS doc_comment FROM {part}"""
_PL = "WITH sym AS (" + _PLANT.format(part="part") + ")"
_EP = f", a AS (SELECT *, {_ENTRY} AS entry_type FROM (SELECT id, name, file_path, start_line, {_TOK} AS t FROM sym WHERE kind = 'function')), b AS (SELECT *, CASE WHEN entry_type IN ('main', 'tokio_main', 'actix_main') THEN 0 WHEN entry_type = 'server' THEN 1 WHEN entry_type = 'cli' THEN 2 ELSE 3 END AS priority, {_EVIDENCE} AS evidence FROM a WHERE entry_type IS NOT NULL) SELECT id, name, file_path, start_line, priority, entry_type, evidence FROM (SELECT *, row_number() OVER (PARTITION BY file_path, start_line ORDER BY priority, id) AS rn FROM b) WHERE rn = 1"
_FR = ", f(name, words, category, evidence) AS (VALUES ('actix', ['actix', 'web'], 'web', 'import of actix_web'), ('axum', ['axum'], 'web', 'import of axum'), ('rocket', ['rocket'], 'web', 'import of rocket'), ('warp', ['warp'], 'web', 'import of warp'), ('tokio', ['tokio'], 'async runtime', 'import of tokio'), ('clap', ['clap'], 'cli', 'import of clap'), ('serde', ['serde'], 'serialization', 'import of serde'), ('React', ['react'], 'web', 'import of React'), ('Vue', ['vue'], 'web', 'import of Vue'), ('Angular', ['angular'], 'web', 'import of angular'), ('Express', ['express'], 'web', 'import of express'), ('Next.js', ['next'], 'web', 'import of next'), ('Jest', ['jest'], 'testing', 'import of jest'), ('Mocha', ['mocha'], 'testing', 'import of mocha'), ('Django', ['django'], 'web', 'import of django'), ('Flask', ['flask'], 'web', 'import of flask'), ('FastAPI', ['fastapi'], 'web', 'import of fastapi'), ('pytest', ['pytest'], 'testing', 'import of pytest'), ('Spring', ['springframework'], 'web', 'import of spring'), ('Spring Boot', ['springbootapplication'], 'web', 'SpringBootApplication annotation'), ('JUnit', ['junit'], 'testing', 'import of junit'))" + f", d AS (SELECT {_TOK} AS t FROM sym) SELECT name, category, evidence FROM f WHERE EXISTS (SELECT 1 FROM d WHERE len(list_filter(t, lambda x: starts_with(x, f.words[-1]))) > 0 AND (len(f.words) = 1 OR list_contains(t, f.words[1])))"



def _planted(s, d):
    return s.sql(_PLANT, part=table(s, d, "part"))


QUERIES = {
    "fts_bm25": lambda s, d: bm25_indexed(*_tokens(s, d), "id", "lock snap"),
    "fts_prefix": lambda s, d: bm25_indexed(*token_index(s, d, "documents", lambda: table(s, d, "documents"), "doc_id", ["text"]), "doc_id", "depth*", 50),
    "fts_blank": lambda s, d: bm25_indexed(*_tokens(s, d), "id", " \"*' "),
    "search_prefix_short": lambda s, d: prefix_search(_s(s, d), "em%i").select(*OUT, "score"),
    "search_fuzzy": lambda s, d: fuzzy(bound_symbols(s, d), "smal_rng", 0.85).select("id", "name", "score"),
    "search_advanced_rank": lambda s, d: advanced(_s(s, d, "visibility"), "cursor", index=_tokens(s, d)).select("id", "name", "rank_score"),
    "search_advanced_metrics": lambda s, d: advanced(_s(s, d, "visibility"), "cursor", file=NEAR, index=_tokens(s, d), metrics=_metrics(s, d)).select("id", "name", "rank_score"),
    "page_keyset_1": lambda s, d: keyset_page(_scored(s, d), 20).select("id", "score", *KEYS[:3]),
    "page_keyset_2": lambda s, d: keyset_page(_scored(s, d), 20, _AFTER).select("id", "score", *KEYS[:3]),
    "page_offset": lambda s, d: offset_page(_scored(s, d), 15, 20).select("id", "score", *KEYS[:3]),
    "diversify_by_directory": lambda s, d: diversify(_scored(s, d), directory(F.col("file_path")), 2, [F.desc("score"), "id"]).select("id", "file_path", "score"),
    "diversify_usages": lambda s, d: context_bundle(bound_symbols(s, d), call_edges(s, d), "small"),
    "overlay_search": lambda s, d: overlay_search(bound_symbols(s, d), _overlay(s, d), "small_ring"),
    "search_by_tag": lambda s, d: _by_tag(s, d).select("id", "name", "file_path"),
    "search_with_file_meta": _with_meta,
    "entry_points": lambda s, d: entry_points(_s(s, d, "signature", "doc_comment")),
    "entry_points_planted": lambda s, d: entry_points(_planted(s, d)),
    "framework_detection": lambda s, d: frameworks(_s(s, d, "signature", "doc_comment")),
    "framework_detection_planted": lambda s, d: frameworks(_planted(s, d)),
    "compass_query": lambda s, d: compass(_s(s, d, "signature"), table(s, d, "project_nodes"), table(s, d, "documents"), "cursor"),
}
ORACLES = {
    "fts_bm25": _bm25_sql(_W, "id", "sym", ["name", "signature", "doc_comment"], "lock snap", 100) + "SELECT * FROM best",
    "fts_prefix": _bm25_sql("WITH x AS (SELECT 1)", "doc_id", "documents", ["text"], "depth*", 50) + "SELECT * FROM best",
    "search_prefix_short": _W + f"SELECT {_O}, CASE WHEN lower(name) = 'emi' THEN 1.0 ELSE 0.8 END::DOUBLE AS score FROM sym WHERE name ILIKE 'emi%' ORDER BY name, id LIMIT 20",
    "search_fuzzy": f"WITH {BSYM_CTE} SELECT id, name, round(jaro_winkler_similarity(lower(name), 'smal_rng'), 6) AS score FROM bsym WHERE (lower(name) LIKE 'sma%' OR lower(name) LIKE '_ma%' OR contains(lower(name), 'smal')) AND round(jaro_winkler_similarity(lower(name), 'smal_rng'), 6) >= 0.85 ORDER BY score DESC, name, id LIMIT 20",
    "search_advanced_rank": _bm25_sql(_W, "id", "sym", ["name", "signature", "doc_comment"], "cursor", 60) + f"SELECT id, name, round(0.4::DOUBLE * least(greatest(score / 10, 0), 1) + 0.2::DOUBLE * {_VIS}, 6) AS rank_score FROM best JOIN sym USING (id) ORDER BY rank_score DESC, id LIMIT 20",
    "fts_blank": "SELECT ''::VARCHAR AS id, 0.0::DOUBLE AS score WHERE FALSE",
    "search_advanced_metrics": _bm25_sql(_W, "id", "sym", ["name", "signature", "doc_comment"], "cursor", 60) + f", h AS (SELECT parent AS id, count(*) / 10.0::DOUBLE AS pr FROM sym WHERE parent IS NOT NULL GROUP BY 1), fl AS (SELECT path, max(last_modified) AS t FROM files WHERE path IS NOT NULL GROUP BY 1), rc AS (SELECT path, round(power(0.5::DOUBLE, ((SELECT max(t) FROM fl) - t) / 7776000.0::DOUBLE), 6) AS rec FROM fl) SELECT id, name, round(0.4::DOUBLE * least(greatest(score / 10, 0), 1) + 0.2::DOUBLE * {_VIS} + 0.2::DOUBLE * least(coalesce(pr, 0), 1) + 0.1::DOUBLE * least(greatest(coalesce(rec, 0), 0), 1) + 0.1::DOUBLE * CASE WHEN file_path = '{NEAR}' THEN 1.0 WHEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) = 'fjord-node/manifestkit-8/app/services' THEN 0.5 ELSE 0.0 END, 6) AS rank_score FROM best JOIN sym USING (id) LEFT JOIN h USING (id) LEFT JOIN rc ON rc.path = sym.file_path ORDER BY rank_score DESC, id LIMIT 20",
    "page_keyset_1": f"WITH {_RING} SELECT id, score, kind, file_path, start_line FROM sc ORDER BY score DESC, kind, file_path, start_line, id LIMIT 20",
    "page_keyset_2": f"WITH {_RING} SELECT id, score, kind, file_path, start_line FROM sc WHERE score < 0.9 OR (score = 0.9 AND (kind, file_path, start_line, id) > ('enum', 'src/brand_22/m1.rs', 1, '')) ORDER BY score DESC, kind, file_path, start_line, id LIMIT 20",
    "page_offset": f"WITH {_RING} SELECT id, score, kind, file_path, start_line FROM sc ORDER BY score DESC, kind, file_path, start_line, id LIMIT 20 OFFSET 15",
    "diversify_by_directory": f"WITH {_RING} SELECT id, file_path, score FROM (SELECT *, row_number() OVER (PARTITION BY regexp_extract(file_path, '^(.*)/[^/]*$', 1) ORDER BY score DESC, id) AS rn FROM sc) WHERE rn <= 2",
    "diversify_usages": f"WITH {EDGES_CTE}, hit AS (SELECT * FROM bsym WHERE name ILIKE 'small%' ORDER BY name, id LIMIT 5), u AS (SELECT * FROM call_edges WHERE symbol_name IN (SELECT name FROM hit) ORDER BY referenced_in_file, line, column_num, symbol_name LIMIT 10) SELECT 'card' AS part, name, file_path AS file, start_line AS line FROM hit UNION ALL SELECT 'usage', symbol_name, referenced_in_file, line FROM (SELECT *, row_number() OVER (PARTITION BY referenced_in_file ORDER BY line, column_num, symbol_name) AS rn FROM u) WHERE rn <= 2",
    "overlay_search": f"WITH {_OV}, a AS (SELECT *, 0 AS origin FROM ov UNION ALL SELECT {_O}, 1 FROM bsym WHERE file_path NOT IN (SELECT file_path FROM ov)) SELECT *, CASE WHEN lower(name) = 'small_ring' THEN 1.0 WHEN starts_with(lower(name), 'small_ring') THEN 0.9 ELSE 0.7 END::DOUBLE AS score FROM a WHERE contains(lower(name), 'small_ring') ORDER BY origin, score DESC, file_path, start_line, id LIMIT 20",
    "search_by_tag": _TAGGED + " SELECT id, name, file_path FROM hit",
    "search_with_file_meta": _TAGGED + " SELECT id, name, file_path, tags FROM hit LEFT JOIN (SELECT file_path, string_agg(DISTINCT concat(category, ':', tag), ',' ORDER BY concat(category, ':', tag)) AS tags FROM file_tags GROUP BY 1) t USING (file_path)",
    "entry_points": f"{_W} {_EP}",
    "entry_points_planted": f"{_PL} {_EP}",
    "framework_detection": f"{_W} {_FR}",
    "framework_detection_planted": f"{_PL} {_FR}",
    "compass_query": _bm25_sql(_W, "id", "sym", ["name", "signature"], "cursor", 4) + "SELECT * FROM (SELECT 'symbol' AS result_type, id AS key, score FROM best UNION ALL (SELECT DISTINCT 'module', id, 0.8::DOUBLE FROM project_nodes WHERE contains(lower(name), 'cursor') ORDER BY id LIMIT 2) UNION ALL (SELECT 'doc', doc_id::VARCHAR, 0.7::DOUBLE FROM documents WHERE regexp_matches(lower(text), '(?m)^#{1,6}[ ].*cursor') ORDER BY doc_id LIMIT 1)) ORDER BY score DESC, result_type, key LIMIT 10",
}
