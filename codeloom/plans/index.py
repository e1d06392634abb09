"""The code index as DataFrames: valid symbols of the symbol table, and a reference model bound to the driver's tables.

The driver has no table of references, imports or tags. They are bound to its order tables by fixed rules, as SQL text
that Spark and the oracle both read, so that every operator over them can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import lang
from codeloom.sources.tables import clean_path, latest, materialise, table

COLUMNS = ["id", "indexed_at", "name", "kind", "file_path", "start_line", "start_column", "end_line", "end_column", "language", "visibility", "signature", "doc_comment", "parent", "return_type", "source_type", "dependency_id"]
# Kinds that are types, and kinds that are no definitions.
TYPE_KINDS = ["struct", "class", "interface", "trait", "enum", "type_alias"]
FUNCTION_KINDS = ["function", "method"]
NO_DEFINITION = ["import", "variable"]


_STORED: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], keys: list[str]) -> DataFrame:
    """A table of the index, built when it is first asked for in a session and kept in the shared folder, in ranges of `keys`
    and sorted by them, so that lookups by key read few row groups. It is built of files that don't change; `forget` drops
    what is kept after they did."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = materialise(build().repartitionByRange(*keys).sortWithinPartitions(*keys))
    return _STORED[key]


def forget() -> None:
    _STORED.clear()


def symbols(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Valid symbols with kind, language and path cleaned."""
    columns = columns or COLUMNS
    if set(columns) <= set(COLUMNS):
        return stored(spark, sf_dir, "symbols", lambda: _valid(spark, sf_dir, COLUMNS), ["name"]).select(*columns)
    return _valid(spark, sf_dir, columns)


def _valid(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    need = list(dict.fromkeys(["id", "indexed_at", *columns, *(["file_path"] if "language" in columns else [])]))
    v = latest(table(spark, sf_dir, "symbols"), "id", "indexed_at", need)
    if "kind" in columns:
        v = v.withColumn("kind", lang.kind(F.col("kind")))
    if "file_path" in need:
        v = v.withColumn("file_path", clean_path(F.col("file_path")))
    if "language" in columns:
        v = v.withColumn("language", lang.language(F.col("language"), F.col("file_path")))
    return v.select(*columns)


def _case(values: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {key} END"


_KIND = _case({v: k for k, v in lang.KIND_CODES.items()}, "lower(trim(kind))")
_LANG = _case(lang.ALIASES, "lower(trim(language))")
#: Oracle: the common table expression of `symbols`.
SYM = f"""sym AS (SELECT id, indexed_at, name, {_KIND} AS kind, regexp_replace(regexp_replace(replace(file_path, chr(92), '/'), '/{{2,}}', '/', 'g'), '^(\\./)+', '') AS file_path, start_line, start_column, end_line, end_column, {_LANG} AS language, visibility, signature, doc_comment, parent, return_type, source_type, dependency_id
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) AS rn FROM symbols WHERE id IS NOT NULL) WHERE rn = 1)"""

# The bound model, in SQL that both engines read.
BOUND_SYMBOLS = """SELECT concat('p', cast(p_partkey AS varchar(20))) AS id,
  CASE WHEN p_partkey % 7 = 3 THEN concat(replace(p_name, ' ', '_'), '_', cast(p_partkey AS varchar(20))) ELSE replace(p_name, ' ', '_') END AS name,
  CASE p_type WHEN 'ECONOMY' THEN 'function' WHEN 'SMALL' THEN 'method' WHEN 'MEDIUM' THEN 'struct' WHEN 'PROMO' THEN 'class' WHEN 'STANDARD' THEN 'trait' ELSE 'enum' END AS kind,
  concat('src/', lower(replace(p_brand, '#', '_')), '/m', cast(p_partkey % 5 AS varchar(20)), '.rs') AS file_path,
  CASE p_partkey % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'java' WHEN 2 THEN 'kotlin' ELSE 'python' END AS language,
  CASE p_partkey % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 2 THEN 'internal' WHEN 3 THEN 'protected' ELSE NULL END AS visibility,
  cast((p_partkey % 97) * 10 + 1 AS int) AS start_line, cast((p_partkey % 97) * 10 + 1 + p_size AS int) AS end_line,
  concat(replace(p_name, ' ', '_'), '(', CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'a: T' WHEN 2 THEN 'a: M<K, V>, b: U' ELSE 'a, (b, c), d' END, ')') AS signature, p_partkey AS seq
FROM {part}"""
REFS = """SELECT symbol_name, referenced_in_file, line, column_num, reference_kind FROM (
 SELECT s.name AS symbol_name, h.file_path AS referenced_in_file, cast(h.start_line + l.l_linenumber AS int) AS line, cast(l.l_quantity AS int) AS column_num,
  CASE l.l_returnflag WHEN 'A' THEN 'type_use' WHEN 'R' THEN 'extend' ELSE 'call' END AS reference_kind,
  row_number() OVER (PARTITION BY s.name, h.file_path, h.start_line + l.l_linenumber, cast(l.l_quantity AS int)
   ORDER BY l.l_orderkey DESC, l.l_linenumber DESC, l.l_suppkey DESC, l.l_partkey DESC, l.l_extendedprice DESC, l.l_shipdate DESC) AS rn
 FROM {lineitem} l JOIN {bsym} s ON s.seq = l.l_partkey
 JOIN {bsym} h ON h.seq = (l.l_orderkey * 31 + l.l_linenumber * 17) % (SELECT count(*) FROM {part})
 WHERE l.l_partkey % 7 <> 3) t WHERE rn = 1"""
CALL_EDGES = """SELECT caller_id, caller_name, symbol_name, referenced_in_file, line, column_num FROM (
 SELECT c.id AS caller_id, c.name AS caller_name, r.symbol_name, r.referenced_in_file, r.line, r.column_num,
  row_number() OVER (PARTITION BY r.symbol_name, r.referenced_in_file, r.line, r.column_num ORDER BY c.end_line - c.start_line, c.start_line DESC, c.id) AS rn
 FROM {refs} r JOIN {bsym} c ON c.file_path = r.referenced_in_file AND c.kind IN ('function', 'method') AND r.line BETWEEN c.start_line AND c.end_line
 WHERE r.reference_kind = 'call') t WHERE rn = 1"""
IMPORTS = """SELECT DISTINCT concat('mod', cast(o_custkey % 200 AS varchar(20)), '/f', cast(o_custkey % 7 AS varchar(20)), '.rs') AS file_path,
 concat('src/', lower(replace(p_brand, '#', '_')), '/m', cast(p_partkey % 5 AS varchar(20)), '.rs') AS imported_path,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE replace(p_name, ' ', '_') END AS imported_symbol,
 CASE o_orderkey % 5 WHEN 0 THEN 'wildcard' WHEN 1 THEN 'module' ELSE 'symbol' END AS import_type
 FROM {orders} JOIN {part} ON p_partkey = o_orderkey % 2000 + 1"""
FILE_TAGS = """SELECT file_path, category, tag, max(confidence) AS confidence FROM (
 SELECT concat('src/', lower(replace(p_brand, '#', '_')), '/m', cast(p_partkey % 5 AS varchar(20)), '.rs') AS file_path, CASE l_linenumber % 2 WHEN 0 THEN 'domain' ELSE 'layer' END AS category,
  CASE l_suppkey % 6 WHEN 0 THEN 'auth' WHEN 1 THEN 'payment' WHEN 2 THEN 'api' WHEN 3 THEN 'db' WHEN 4 THEN 'service' ELSE 'ui' END AS tag, l_discount AS confidence
 FROM {lineitem} JOIN {part} ON p_partkey = l_partkey) t GROUP BY file_path, category, tag"""


def bound_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BOUND_SYMBOLS, part=table(spark, sf_dir, "part"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "refs", lambda: spark.sql(REFS, lineitem=table(spark, sf_dir, "lineitem"), part=table(spark, sf_dir, "part"), bsym=bound_symbols(spark, sf_dir)), ["symbol_name"])


BUCKET = 64


def covered(start: str, end: str) -> Column:
    """The buckets of lines that a span covers, one row for each."""
    return F.explode(F.sequence(F.floor(F.col(start) / BUCKET), F.floor(F.col(end) / BUCKET))).alias("bucket")


def inside(points: DataFrame, spans: DataFrame, file: str) -> DataFrame:
    """Points (file, line, ...) joined with every span (file, start_line, end_line, ...) around them: a range join in buckets
    of lines, in which a point meets only the spans that cover its bucket, however many its file has."""
    s = spans.filter("end_line >= start_line").select("*", covered("start_line", "end_line"))
    return points.withColumn("bucket", F.floor(F.col("line") / BUCKET)).join(s, [file, "bucket"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line"))).drop("bucket")


def edges_of(r: DataFrame, functions: DataFrame) -> DataFrame:
    """Each call with the innermost function around it: least span, then the later start, then the id."""
    calls = r.filter("reference_kind = 'call'").select("symbol_name", "referenced_in_file", "line", "column_num")
    f = functions.filter(F.col("kind").isin(FUNCTION_KINDS)).select("id", "name", F.col("file_path").alias("referenced_in_file"), "start_line", "end_line")
    keys = ["symbol_name", "referenced_in_file", "line", "column_num"]
    best = inside(calls, f, "referenced_in_file").groupBy(*keys).agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("w"), (-F.col("start_line")).alias("s"), "id", "name")).alias("b"))
    return best.select(F.col("b.id").alias("caller_id"), F.col("b.name").alias("caller_name"), *keys)


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "call_edges", lambda: edges_of(refs(spark, sf_dir), bound_symbols(spark, sf_dir)), ["symbol_name"])


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(IMPORTS, orders=table(spark, sf_dir, "orders"), part=table(spark, sf_dir, "part"))


def file_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FILE_TAGS, lineitem=table(spark, sf_dir, "lineitem"), part=table(spark, sf_dir, "part"))


_NAMES = {"part": "part", "lineitem": "lineitem", "orders": "orders", "bsym": "bsym", "refs": "refs"}
#: Oracle: common table expressions of the bound model, in an order in which each may use those before.
BSYM_CTE = "bsym AS (" + BOUND_SYMBOLS.format(**_NAMES) + ")"
REFS_CTE = BSYM_CTE + ", refs AS (" + REFS.format(**_NAMES) + ")"
EDGES_CTE = REFS_CTE + ", call_edges AS (" + CALL_EDGES.format(**_NAMES) + ")"
IMPORTS_CTE = "imports AS (" + IMPORTS.format(**_NAMES) + ")"
TAGS_CTE = "file_tags AS (" + FILE_TAGS.format(**_NAMES) + ")"
