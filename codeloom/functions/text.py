"""Scalar and text functions as column expressions, and the operators over Markdown and configuration texts.

Everything stays in the JVM. A document is taken line by line with posexplode; running states (open fences) are windows
over the lines of one document, whose size is that of its text.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.plans.index import SYM, symbols
from codeloom.sources.tables import materialise, table

# Patterns of secrets, replaced one after the other. All are readable by RE2 and by Java.
SECRETS = [
    r"""(?i)(api[_-]?key|apikey)\s*[=:]\s*["']?[A-Za-z0-9_\-]{20,}["']?""",
    r"""(?i)bearer\s+[A-Za-z0-9_\-\.]{20,}""",
    r"""(?i)(aws[_-]?access[_-]?key[_-]?id|aws[_-]?secret[_-]?access[_-]?key)\s*[=:]\s*["']?[A-Za-z0-9/+=]{20,}["']?""",
    r"""(?i)(private[_-]?key|secret[_-]?key|password|passwd|pwd)\s*[=:]\s*["'][^"']{8,}["']""",
    r"""(?i)(secret|token|credential|auth)\s*[=:]\s*["']?[A-Za-z0-9_\-]{16,}["']?""",
    r"""eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}""",
    r"""gh[pousr]_[A-Za-z0-9]{36,}""",
    r"""(?i)(postgres|mysql|mongodb|redis)://[^:]+:[^@]+@""",
]
REDACTED = "[REDACTED]"
# Words that make a section of a document a key section.
KEY_SECTIONS = [
    "install", "installation", "getting started", "setup", "quick start", "usage", "how to use", "examples", "example", "api", "api reference", "reference", "configuration", "config", "options",
    "contributing", "development", "building", "build", "testing", "tests", "test", "license", "changelog", "changes", "requirements", "prerequisites", "dependencies",
]
# Languages of fences that hold commands, and what a first line with a command begins with.
SHELLS = ["bash", "sh", "shell", "zsh", "console", "terminal", "cmd", "powershell", "ps1"]
COMMANDS = ["$ ", "> ", "npm ", "yarn ", "pnpm ", "cargo ", "make ", "docker ", "git ", "pip ", "python ", "go "]


def redact(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


def cut_bytes(text: Column, limit: int) -> Column:
    """At most `limit` bytes of UTF-8, cut at a character; what is cut ends in '...'.

    The longest prefix is found by halving over lengths, in as many steps as the limit has bits.
    """
    if limit < 3:
        return F.when(F.octet_length(text) <= limit, text).otherwise("...")
    def halve(a, _):
        mid = F.ceil((a["lo"] + a["hi"]) / 2).cast("int")
        fits = F.octet_length(F.substring(text, F.lit(1), mid)) <= limit - 3
        return F.struct(F.when(fits, mid).otherwise(a["lo"]).alias("lo"), F.when(fits, a["hi"]).otherwise(mid - 1).alias("hi"))

    steps = F.sequence(F.lit(0), F.lit(max(1, limit.bit_length() + 1)))
    lo = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.least(F.length(text), F.lit(limit - 3)).alias("hi")), halve, lambda a: a["lo"])
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.substring(text, F.lit(1), lo), F.lit("...")))


def budget(df: DataFrame, group: list[str], order: list, item: Column, max_items: int, max_bytes: int) -> DataFrame:
    """The longest head of each group's items within a number and a number of bytes, a separator each."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).withColumn("_b", F.sum(F.octet_length(item) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("_n") <= max_items) & (F.col("_b") + 1 <= max_bytes)).drop("_n", "_b")


def encode_cursor(fields: dict) -> str:
    """A page cursor: JSON in URL-safe base64 without padding."""
    return base64.urlsafe_b64encode(json.dumps(fields, separators=(",", ":"), sort_keys=True).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> dict:
    return json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    d = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("i", "line"))
    return d.select(key, (F.col("i") + 1).cast("int").alias("n"), "line")


def headings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, level, title): lines of 1 to 6 '#', a blank and a text; also those within fences."""
    return lines(df, key, text).select(key, "n", F.length(F.regexp_extract("line", r"^\s*(#{1,6})\s+\S", 1)).cast("int").alias("level"), F.trim(F.regexp_extract("line", r"^\s*#{1,6}\s+(.*)$", 1)).alias("title")).filter("level > 0 and title <> ''")


def code_blocks(df: DataFrame, key: str, text: str, fence: str = "```") -> DataFrame:
    """(key, n, language, content) of each closed block between two fence lines; n is the opening line."""
    li = lines(df, key, text).withColumn("f", F.ltrim("line").startswith(fence).cast("int"))
    w = Window.partitionBy(key).orderBy("n")
    li = li.withColumn("k", F.sum("f").over(w)).withColumn("last", F.sum("f").over(Window.partitionBy(key)))
    inside = (F.col("k") % 2 == 1) & (F.col("k") < F.col("last"))
    g = li.filter(inside).withColumn("block", F.floor(F.col("k") / 2)).groupBy(key, "block")
    out = g.agg(F.min("n").cast("int").alias("n"), F.min_by("line", "n").alias("head"), F.array_sort(F.collect_list(F.when(F.col("f") == 0, F.struct("n", "line")))).alias("ls"))
    return out.select(key, "n", F.nullif(F.regexp_extract(F.ltrim("head"), r"^`+\s*(\S*)", 1), F.lit("")).alias("language"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content"))


def is_command(language: Column, content: Column) -> Column:
    """Whether a fenced block holds commands: by its language, else by how its first line begins."""
    first = F.element_at(F.split(content, "\n"), 1)
    begins = F.lit(False)
    for x in COMMANDS:
        begins = begins | first.startswith(x)
    return F.coalesce(F.lower(language).isin(SHELLS), F.lit(False)) | begins


def command_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    return code_blocks(df, key, text).filter(is_command(F.col("language"), F.col("content")))


def key_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, title, start_line, end_line): sections whose title has a key word, up to the line before the next heading of
    the same or a higher level, else to the end of the text."""
    h = headings(df, key, text)
    total = df.filter(F.col(text).isNotNull()).select(key, F.size(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("total"))
    good = F.lit(False)
    for w in KEY_SECTIONS:
        good = good | F.lower("title").contains(w)
    a = h.filter(good).select(key, "title", F.col("n").alias("start_line"), F.col("level").alias("lv"))
    b = h.select(F.col(key).alias("k2"), F.col("n").alias("n2"), F.col("level").alias("l2"))
    j = a.join(b, (F.col(key) == F.col("k2")) & (F.col("n2") > F.col("start_line")) & (F.col("l2") <= F.col("lv")), "left")
    return j.groupBy(key, "title", "start_line").agg(F.min("n2").alias("nxt")).join(total, key).select(key, "title", "start_line", F.coalesce(F.col("nxt") - 1, F.col("total")).cast("int").alias("end_line"))


def section(df: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, title, body): the text under the first heading that has the query."""
    h = headings(df, key, text)
    first = h.filter(F.lower("title").contains(query.lower())).groupBy(key).agg(F.min(F.struct("n", "level", "title")).alias("h")).select(key, F.col("h.n").alias("a"), F.col("h.level").alias("lv"), F.col("h.title").alias("title"))
    nxt = h.join(first, key).filter((F.col("n") > F.col("a")) & (F.col("level") <= F.col("lv"))).groupBy(key).agg(F.min("n").alias("z"))
    li = lines(df, key, text).join(first, key).join(nxt, key, "left").filter((F.col("n") > F.col("a")) & (F.col("z").isNull() | (F.col("n") < F.col("z"))))
    body = li.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("ls"))
    return first.join(body, key, "left").select(key, "title", F.regexp_replace(F.coalesce(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("")), r"^\s+|\s+$", "").alias("body"))


def fqdn(df: DataFrame) -> DataFrame:
    """Qualified names by each language's convention: Rust modules after src, Java and Kotlin packages after java or
    kotlin, TypeScript and Python folders after src, Go the package."""
    stem = F.regexp_replace(F.col("file_path"), r"\.[^./]*$", "")
    rel = F.regexp_replace(stem, r"^(?:.*/)?src/(?:main/(?:java|kotlin)/)?", "")
    rel = F.regexp_replace(rel, r"/(?:mod|lib|main|index|__init__)$", "")
    sep = F.when(F.col("language") == "rust", "::").otherwise(".")
    return df.select("id", F.when(F.col("language") == "go", F.concat(F.element_at(F.split(stem, "/"), -2), F.lit("."), "name")).otherwise(F.concat(F.when(F.col("language") == "rust", F.replace(rel, F.lit("/"), F.lit("::"))).otherwise(F.replace(rel, F.lit("/"), F.lit("."))), sep, "name")).alias("fqdn"))


def go_receiver(signature: Column) -> Column:
    return F.nullif(F.regexp_extract(signature, r"^func\s*\(\s*\w*\s*\*?\s*([A-Za-z_]\w*)\s*\)", 1), F.lit(""))


def dictionary_encode(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, code): dense codes from 0 in the order of first appearance; only distinct values are numbered."""
    first = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first"))
    # Ranges in order of appearance, numbered within and shifted by the sizes of those before: no task sees all values.
    ranged = materialise(first.repartitionByRange("first", "value").withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))  # a row per partition
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("range").orderBy("first", "value")) - 1
    return ranged.withColumn("number", number).join(F.broadcast(before), "range").select("value", (F.col("number") + F.col("before")).cast("int").alias("code"))


def dictionary_decode(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """Rows whose `column` is a code, with the value instead; unknown codes give null."""
    return df.join(codes.select(F.col("code").alias(column), F.col("value").alias("_v")), column, "left").withColumn(column, F.col("_v")).drop("_v")


def dictionary_extend(codes: DataFrame, df: DataFrame, column: str, order: str) -> DataFrame:
    """Codes of the values a dictionary hasn't yet, going on from its greatest: what a session must send."""
    new = df.join(codes.select(F.col("value").alias(column)), column, "left_anti")
    top = codes.agg(F.coalesce(F.max("code") + 1, F.lit(0)).alias("top"))
    return dictionary_encode(new, column, order).crossJoin(F.broadcast(top)).select("value", (F.col("code") + F.col("top")).alias("code"))


def makefile_targets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, target) of lines 'target:' that are no pattern, variable or hidden target."""
    t = F.regexp_extract("line", r"^([A-Za-z0-9_][\w.-]*)\s*:(?!=)", 1)
    return lines(df, key, text).select(key, t.alias("target")).filter("target <> ''").distinct()


def package_scripts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, script, command, role) of the scripts of package.json texts; texts that aren't JSON have none."""
    s = F.from_json(F.get_json_object(text, "$.scripts"), "map<string,string>")
    n = F.lower("script")
    role = F.when(n.contains("build") | n.contains("compile"), "build").when(n.contains("test") | n.isin("jest", "mocha"), "test").when(n.isin("start", "dev", "serve"), "run").otherwise("other")
    return df.select(key, F.explode(s).alias("script", "command")).withColumn("role", role)


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text", "created_at")


def _coded(s, d):
    return table(s, d, "documents").withColumn("o", F.struct(F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0)).alias("t"), "doc_id"))


def _roundtrip(s, d):
    codes = dictionary_encode(_coded(s, d), "source", "o")
    coded = _coded(s, d).join(codes.withColumnRenamed("value", "source"), "source", "left").select("doc_id", "code")
    return dictionary_decode(coded, codes, "code").select("doc_id", F.col("code").alias("source"))


_PKG = "concat('{\"name\": \"p', doc_id, '\", \"scripts\": {\"build\": \"make ', coalesce(lang, ''), '\", \"unit-test\": \"run ', doc_id, '\", \"start\": \"node x\"}}')"
_PLANTED = """concat('API-KEY: ', repeat('k', 20), '; bearer ', repeat('a.b', 8), ' private_key="', repeat('p', 8), '" SECRET=abcdefghijklmnop', doc_id, ' aws_secret_access_key=', repeat('A/', 11), chr(10), 'postgres://u:p', doc_id, '@host; eyJ', repeat('x', 10), '.', repeat('y', 10), '.', repeat('z', 10), '; ghp_', repeat('7', 36), '; aws_secret_access_key=short; password=plain; pwd = "short"')"""
_CMDS = """concat('```', CASE doc_id % 4 WHEN 0 THEN 'BASH' WHEN 1 THEN 'ps1' WHEN 2 THEN '' ELSE 'rust' END, chr(10), CASE doc_id % 3 WHEN 0 THEN 'pnpm i' WHEN 1 THEN 'x = ' ELSE 'cargox run' END, doc_id, chr(10), 'yarn x', chr(10), '```', chr(10))"""
_MAKE = "concat('.PHONY: all', chr(10), 'all: build', chr(10), chr(9), 'echo ', doc_id, chr(10), 'VAR := 1', chr(10), 'test', doc_id % 7, ':', chr(10), '%.o: x', chr(10))"


def _made(s, d, sql: str):
    return table(s, d, "documents").select("doc_id", F.expr(sql.replace("chr(", "char(")).alias("text"))


_SYMS = ["id", "name", "language", "file_path", "signature"]
_LI = "d AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL), li AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1)::INT AS n FROM d)"
_HD = _LI + ", h AS (SELECT * FROM (SELECT doc_id, n, length(regexp_extract(line, '^\\s*(#{1,6})\\s+\\S', 1))::INT AS level, trim(regexp_extract(line, '^\\s*#{1,6}\\s+(.*)$', 1)) AS title FROM li) WHERE level > 0 AND title <> '')"
_RED = "text"
for _p in (
    r"""(api[_-]?key|apikey)\s*[=:]\s*["\']?[A-Za-z0-9_\-]{20,}["\']?""", r"""bearer\s+[A-Za-z0-9_\-\.]{20,}""", r"""(aws[_-]?access[_-]?key[_-]?id|aws[_-]?secret[_-]?access[_-]?key)\s*[=:]\s*["\']?[A-Za-z0-9/+=]{20,}["\']?""",
    r"""(private[_-]?key|secret[_-]?key|password|passwd|pwd)\s*[=:]\s*["\'][^"\']{8,}["\']""", r"""(secret|token|credential|auth)\s*[=:]\s*["\']?[A-Za-z0-9_\-]{16,}["\']?""", r"""(?-i)eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}""", r"""(?-i)gh[pousr]_[A-Za-z0-9]{36,}""", r"""(postgres|mysql|mongodb|redis)://[^:]+:[^@]+@""",
):
    _RED = f"regexp_replace({_RED}, '{_p.replace(chr(92) + chr(39), chr(39) * 2)}', '[REDACTED]', 'gi')"
_KEYS = "regexp_matches(lower(title), 'install|getting started|setup|quick start|usage|how to use|example|api|reference|config|options|contributing|development|build|test|license|changelog|changes|requirements|prerequisites|dependencies')"
_REL = "regexp_replace(regexp_replace(regexp_replace(file_path, '\\.[^./]*$', ''), '^(?:.*/)?src/(?:main/(?:java|kotlin)/)?', ''), '/(?:mod|lib|main|index|__init__)$', '')"
QUERIES = {
    "redact_secrets": lambda s, d: _docs(s, d).filter(F.col("text").isNotNull()).select("doc_id", F.md5(redact(F.col("text"))).alias("redacted")),
    "redact_secrets_planted": lambda s, d: _docs(s, d).select("doc_id", redact(F.expr(_PLANTED.replace("chr(", "char("))).alias("redacted")),
    "budget_truncate": lambda s, d: _docs(s, d).filter(F.col("text").isNotNull()).select("doc_id", cut_bytes(F.col("text"), 80).alias("head")),
    "budget_items": lambda s, d: budget(table(s, d, "documents").filter("text is not null and source is not null").select("source", "doc_id", "text"), ["source"], ["doc_id"], F.col("text"), 20, 8000).select("source", "doc_id"),
    "doc_headings": lambda s, d: headings(_docs(s, d), "doc_id", "text"),
    "doc_code_blocks": lambda s, d: code_blocks(_docs(s, d), "doc_id", "text"),
    "doc_command_blocks": lambda s, d: command_blocks(_docs(s, d), "doc_id", "text").select("doc_id", "n"),
    "doc_command_blocks_planted": lambda s, d: command_blocks(_made(s, d, _CMDS), "doc_id", "text").select("doc_id", "n", "content"),
    "doc_key_sections": lambda s, d: key_sections(_docs(s, d), "doc_id", "text"),
    "doc_section": lambda s, d: section(_docs(s, d), "doc_id", "text", "install"),
    "fqdn": lambda s, d: fqdn(symbols(s, d, _SYMS)),
    "go_receiver": lambda s, d: symbols(s, d, _SYMS).filter("language = 'go'").select("id", go_receiver(F.col("signature")).alias("receiver")),
    "dict_encode": lambda s, d: dictionary_encode(_coded(s, d), "source", "o"),
    "dict_roundtrip": _roundtrip,
    "dict_delta": lambda s, d: dictionary_extend(dictionary_encode(_coded(s, d).filter("doc_id % 4 = 0 and source < 'q'"), "source", "o"), _coded(s, d), "source", "o").select("value"),
    "makefile_targets": lambda s, d: makefile_targets(_made(s, d, _MAKE), "doc_id", "text"),
    "package_scripts": lambda s, d: package_scripts(_made(s, d, _PKG), "doc_id", "text"),
}
ORACLES = {
    "redact_secrets": f"SELECT doc_id, md5({_RED}) AS redacted FROM documents WHERE text IS NOT NULL",
    "redact_secrets_planted": "SELECT doc_id, '[REDACTED]; [REDACTED] [REDACTED] [REDACTED] [REDACTED]' || chr(10) || '[REDACTED]host; [REDACTED]; [REDACTED]; aws_secret_access_key=short; password=plain; pwd = \"short\"' AS redacted FROM documents",
    "budget_truncate": "SELECT doc_id, CASE WHEN strlen(text) <= 80 THEN text ELSE concat(text[1:list_max(list_filter(range(0, 78), lambda i: strlen(text[1:i]) <= 77))], '...') END AS head FROM documents WHERE text IS NOT NULL",
    "budget_items": "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER w AS n, sum(strlen(text) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS b FROM documents WHERE text IS NOT NULL AND source IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE n <= 20 AND b + 1 <= 8000",
    "doc_headings": f"WITH {_HD} SELECT doc_id, n, level, title FROM h",
    "doc_code_blocks": f"WITH {_LI}, f AS (SELECT *, sum(CASE WHEN starts_with(ltrim(line, ' '), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS k, sum(CASE WHEN starts_with(ltrim(line, ' '), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS z FROM li) SELECT doc_id, min(n) AS n, nullif(regexp_extract(ltrim(arg_min(line, n), ' '), '^`+\\s*(\\S*)', 1), '') AS language, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT starts_with(ltrim(line, ' '), '```')), '') AS content FROM f WHERE k % 2 = 1 AND k < z GROUP BY doc_id, k",
    "doc_key_sections": f"WITH {_HD} SELECT a.doc_id, a.title, a.n AS start_line, coalesce((SELECT min(b.n) - 1 FROM h b WHERE b.doc_id = a.doc_id AND b.n > a.n AND b.level <= a.level), (SELECT len(ls) FROM d WHERE d.doc_id = a.doc_id))::INT AS end_line FROM h a WHERE {_KEYS}",
    "doc_section": f"WITH {_HD}, f AS (SELECT doc_id, min(n) AS a FROM h WHERE contains(lower(title), 'install') GROUP BY 1), g AS (SELECT f.doc_id, a, h.title, (SELECT min(n) FROM h x WHERE x.doc_id = f.doc_id AND x.n > a AND x.level <= h.level) AS z FROM f JOIN h ON h.doc_id = f.doc_id AND h.n = a) SELECT g.doc_id, g.title, regexp_replace(coalesce((SELECT string_agg(line, chr(10) ORDER BY n) FROM li WHERE li.doc_id = g.doc_id AND n > a AND (z IS NULL OR n < z)), ''), '^\\s+|\\s+$', '', 'g') AS body FROM g",
    "fqdn": f"WITH {SYM} SELECT id, CASE language WHEN 'go' THEN concat(string_split(regexp_replace(file_path, '\\.[^./]*$', ''), '/')[-2], '.', name) WHEN 'rust' THEN concat(replace({_REL}, '/', '::'), '::', name) ELSE concat(replace({_REL}, '/', '.'), '.', name) END AS fqdn FROM sym",
    "go_receiver": f"WITH {SYM} SELECT id, nullif(regexp_extract(signature, '^func\\s*\\(\\s*\\w*\\s*\\*?\\s*([A-Za-z_]\\w*)\\s*\\)', 1), '') AS receiver FROM sym WHERE language = 'go'",
    "dict_encode": "SELECT source AS value, (row_number() OVER (ORDER BY f, source) - 1)::INT AS code FROM (SELECT source, min((coalesce(epoch_us(created_at), 0), doc_id)) AS f FROM documents WHERE source IS NOT NULL GROUP BY 1)",
    "dict_roundtrip": "SELECT doc_id, source FROM documents",
    "dict_delta": "SELECT DISTINCT source AS value FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM documents WHERE doc_id % 4 = 0 AND source < 'q')",
    "doc_command_blocks": f"WITH {_LI}, f AS (SELECT *, sum(CASE WHEN starts_with(ltrim(line, ' '), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS k, sum(CASE WHEN starts_with(ltrim(line, ' '), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS z FROM li), b AS (SELECT doc_id, min(n) AS n, regexp_extract(ltrim(arg_min(line, n), ' '), '^`+\\s*(\\S*)', 1) AS language, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT starts_with(ltrim(line, ' '), '```')), '') AS content FROM f WHERE k % 2 = 1 AND k < z GROUP BY doc_id, k) SELECT doc_id, n FROM b WHERE lower(language) IN ('bash', 'sh', 'shell', 'zsh', 'console', 'terminal', 'cmd', 'powershell', 'ps1') OR regexp_matches(content, '^(\\$ |> |npm |yarn |pnpm |cargo |make |docker |git |pip |python |go )')",
    "doc_command_blocks_planted": "SELECT doc_id, 1 AS n, concat(CASE doc_id % 3 WHEN 0 THEN 'pnpm i' WHEN 1 THEN 'x = ' ELSE 'cargox run' END, doc_id, chr(10), 'yarn x') AS content FROM documents WHERE doc_id % 4 < 2 OR doc_id % 3 = 0",
    "makefile_targets": "SELECT DISTINCT doc_id, unnest(['all', concat('test', doc_id % 7)]) AS target FROM documents",
    "package_scripts": "SELECT doc_id, unnest(['build', 'unit-test', 'start']) AS script, unnest([concat('make ', lang), concat('run ', doc_id), 'node x']) AS command, unnest(['build', 'test', 'run']) AS role FROM documents",
}
