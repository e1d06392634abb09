"""Tags of files: relational division, synonyms, glob rules, inferred tags and their statistics.

Rules and dictionaries are small tables the caller owns; they are broadcast by Spark if their measured size allows it.
Globs become regular expressions once, on the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.plans.index import SYM, TAGS_CTE, file_tags, symbols

# The seed dictionary (id, category, name, synonyms).
DICTIONARY = [
    (1, "domain", "auth", ["authn", "login", "sso"]), (2, "domain", "payments", ["billing", "checkout"]), (3, "layer", "api", ["rest", "handler", "controller"]), (4, "layer", "service", ["business", "usecase"]), (5, "layer", "repository", ["dao", "store"]),
    (6, "layer", "model", ["entity", "dto"]), (7, "pattern", "idempotency", ["idempotent"]), (8, "pattern", "cache", ["memoize"]), (9, "pattern", "retry", ["backoff"]), (10, "infra", "test", ["spec", "fixture"]), (11, "infra", "config", ["settings", "env"]), (12, "infra", "cli", ["command", "args"]), (13, "infra", "mcp", ["tool", "server"]),
]
RULES = [("**/brand_1*/**", "domain:auth", 0.9), ("src/**/m1.rs", "layer:api", 0.7), ("**/m[23].rs", "layer:db", 0.8), ("src/brand_1?/*.rs", "layer:api", 0.7), ("**", "layer:ui", 0.0), ("[", "layer:db", 0.99)]


def glob_regex(glob: str) -> str | None:
    """The pattern of a glob: ** and * may cross folders, ? is one sign, [] a set; None if the glob is malformed."""
    out, i, g = "", 0, glob.replace("\\", "/")
    while i < len(g):
        c = g[i]
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif c == "*":
            while i < len(g) and g[i] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out, i = out + ".", i + 1
        elif c == "[":
            j = g.find("]", i + 2)
            if j < 0:
                return None
            body = g[i + 1 : j].replace("\\", "\\\\").replace("^", "\\^")
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]", j + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def with_all_tags(tags: DataFrame, wanted: list[tuple[str | None, str]]) -> DataFrame:
    """Files that have every one of the tags (category or None for any, name): relational division."""
    each = [F.when((F.col("tag") == name) & (F.lit(category is None) | (F.col("category") == (category or ""))), i) for i, (category, name) in enumerate(wanted)]
    k = F.explode(F.array_compact(F.array(*each)))
    return tags.select("file_path", k.alias("k")).groupBy("file_path").agg(F.countDistinct("k").alias("n")).filter(F.col("n") == len(wanted)).select("file_path")


def dictionary(spark) -> DataFrame:
    return spark.createDataFrame(DICTIONARY, "tag_id int, category string, name string, synonyms array<string>")


def resolve_synonyms(words: DataFrame, d: DataFrame) -> DataFrame:
    """(word, category, name): the first dictionary entry whose name or synonym a word is, without case."""
    every = d.select("tag_id", "category", "name", F.explode(F.concat(F.array("name"), "synonyms")).alias("s"))
    first = every.groupBy(F.lower("s").alias("k")).agg(F.min_by(F.struct("category", "name"), "tag_id").alias("t"))
    return words.withColumn("k", F.lower(F.trim("word"))).join(first, "k").select("word", "t.category", "t.name")


def apply_rules(paths: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """(file_path, tag, confidence, pattern): of the rules that match a path, the best for each tag; the first rule wins
    ties, confidence 0 sets nothing, malformed globs are skipped."""
    hits = [F.when(F.col("file_path").rlike(x) & F.lit(c > 0), F.struct(F.lit(t).alias("tag"), F.lit(float(c)).alias("confidence"), F.lit(-i).alias("o"), F.lit(g).alias("pattern"))) for i, (g, t, c) in enumerate(rules) if (x := glob_regex(g))]
    each = paths.select("file_path", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return each.groupBy("file_path", "h.tag").agg(F.max(F.struct("h.confidence", "h.o", "h.pattern")).alias("b")).select("file_path", "tag", "b.confidence", "b.pattern")


def preview_rules(paths: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """How many paths each rule matches."""
    n = paths.agg(*[F.count_if(F.col("file_path").rlike(x)).alias(str(i)) for i, (g, _, _) in enumerate(rules) if (x := glob_regex(g))])
    return n.unpivot([], n.columns, "rule", "files").select(F.col("rule").cast("int").alias("rule"), "files")


def tag_stats(tags: DataFrame, d: DataFrame) -> DataFrame:
    t = tags.select(F.col("category"), F.col("tag").alias("name"), "file_path")
    return d.join(t, ["category", "name"]).groupBy("category", "name").agg(F.count("*").alias("files"))


def files_with_tags(tags: DataFrame) -> DataFrame:
    return tags.groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "category", "tag"))), ",").alias("tags"), F.round(F.max("confidence"), 6).alias("best"))


def _paths(s, d):
    return file_tags(s, d).select("file_path").distinct()


def _words(s, d):
    return symbols(s, d, ["name"]).select(F.lower("name").alias("word")).distinct().unionByName(s.createDataFrame([("Login",), (" authn",), ("billing",), ("REST",), ("nothing",)], "word string"))


_W = f"WITH {TAGS_CTE} "
_DICT = "dict AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', '{n}', {s!r})" for i, c, n, s in DICTIONARY) + ") t(tag_id, category, name, synonyms))"
_P = ", p AS (SELECT DISTINCT file_path FROM file_tags), r(o, gl, re, tag, c) AS (VALUES " + ", ".join(f"({i}, '{g}', '{glob_regex(g)}', '{t}', {c}::DOUBLE)" for i, (g, t, c) in enumerate(RULES) if glob_regex(g)) + ")"
QUERIES = {
    "files_with_all_tags": lambda s, d: with_all_tags(file_tags(s, d), [("domain", "auth"), (None, "service")]),
    "tag_synonym_resolve": lambda s, d: resolve_synonyms(_words(s, d), dictionary(s)),
    "apply_tag_rules": lambda s, d: apply_rules(_paths(s, d), RULES),
    "preview_tag_rules": lambda s, d: preview_rules(_paths(s, d), RULES),
    "tag_stats": lambda s, d: tag_stats(file_tags(s, d), dictionary(s)),
    "file_meta_with_tags": lambda s, d: files_with_tags(file_tags(s, d)),
    "glob_filter": lambda s, d: symbols(s, d, ["file_path"]).distinct().filter(F.col("file_path").rlike(glob_regex("**/src/*/[a-m]*_?*.rs"))),
}
ORACLES = {
    "files_with_all_tags": _W + "SELECT DISTINCT file_path FROM file_tags WHERE category = 'domain' AND tag = 'auth' AND file_path IN (SELECT file_path FROM file_tags WHERE tag = 'service')",
    "tag_synonym_resolve": f"WITH {SYM}, {_DICT}, w AS (SELECT DISTINCT lower(name) AS word FROM sym UNION ALL SELECT unnest(['Login', ' authn', 'billing', 'REST', 'nothing'])) SELECT word, category, name FROM (SELECT w.word, d.category, d.name, row_number() OVER (PARTITION BY w.word ORDER BY tag_id) AS rn FROM w JOIN dict d ON lower(trim(w.word)) = d.name OR list_contains(d.synonyms, lower(trim(w.word)))) WHERE rn = 1",
    "apply_tag_rules": _W + _P + " SELECT file_path, tag, c AS confidence, gl AS pattern FROM (SELECT *, row_number() OVER (PARTITION BY file_path, tag ORDER BY c DESC, o) AS rn FROM p JOIN r ON regexp_matches(file_path, re) WHERE c > 0) WHERE rn = 1",
    "preview_tag_rules": _W + _P + " SELECT o AS rule, count(file_path) AS files FROM r LEFT JOIN p ON regexp_matches(file_path, re) GROUP BY 1",
    "tag_stats": _W + f", {_DICT} SELECT d.category, d.name, count(*) AS files FROM dict d JOIN file_tags t ON t.category = d.category AND t.tag = d.name GROUP BY 1, 2",
    "file_meta_with_tags": _W + "SELECT file_path, string_agg(DISTINCT concat(category, ':', tag), ',' ORDER BY concat(category, ':', tag)) AS tags, round(max(confidence), 6) AS best FROM file_tags GROUP BY 1",
    "glob_filter": f"WITH {SYM} SELECT DISTINCT file_path FROM sym WHERE regexp_matches(file_path, '^(?:.*/)?src/.*/[a-m].*_..*\\.rs$')",
}
