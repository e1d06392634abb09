"""Scopes, name resolution, configuration files, project profiles and the compact project overview."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import lang
from codeloom.functions.text import SHELLS, code_blocks
from codeloom.operators.graph import KOTLIN_TO_JAVA, NO_JAVA_TYPE
from codeloom.operators.stats import directory, directory_rollup, language_share
from codeloom.plans.index import BSYM_CTE, BUCKET, FUNCTION_KINDS, IMPORTS_CTE, REFS_CTE, SYM, TYPE_KINDS, bound_symbols, covered, imports, inside, refs, symbols
from codeloom.sources.extract import BUILTINS
from codeloom.sources.tables import table

SCOPE_KINDS = {"function": "function", "method": "function", "class": "class", "struct": "class", "interface": "class", "trait": "class", "enum": "class", "module": "module"}
# Commands of build tools by manifest.
TOOLS = {"cargo": ("cargo build", "cargo test", "cargo run"), "npm": ("npm run build", "npm test", "npm start"), "maven": ("mvn package", "mvn test", "mvn exec:java"), "gradle": ("gradle build", "gradle test", "gradle run")}
PRIMARY = {"cargo": "rust", "npm": "typescript", "maven": "java", "gradle": "kotlin"}
# Files at a project's root that matter most, in order.
IMPORTANT = ["README.md", "README", "CLAUDE.md", "AGENTS.md", "Cargo.toml", "package.json", "build.gradle.kts", "build.gradle", "pom.xml", "src/lib.rs", "src/main.rs", "src/index.ts", "tsconfig.json", ".env.example", "docker-compose.yml", "Dockerfile"]


def scopes(df: DataFrame) -> DataFrame:
    """(id, parent_scope, kind, name, file_path, start_line, end_line, width): symbols that open a scope, each with the
    least scope around it in its file. A range join in buckets of lines: a scope is compared only with those that cover
    the bucket in which it starts."""
    s = df.withColumn("scope_kind", lang.lookup(SCOPE_KINDS, F.col("kind"))).filter("scope_kind is not null and end_line >= start_line").select("id", "scope_kind", "name", "file_path", "start_line", "end_line", (F.col("end_line") - F.col("start_line")).alias("width"))
    o = s.select("file_path", F.col("id").alias("o_id"), F.col("start_line").alias("o_s"), F.col("end_line").alias("o_e"), F.col("width").alias("o_w"), covered("start_line", "end_line"))
    j = s.withColumn("bucket", F.floor(F.col("start_line") / BUCKET)).join(o, ["file_path", "bucket"]).filter((F.col("o_s") <= F.col("start_line")) & (F.col("o_e") >= F.col("end_line")) & (F.col("o_w") > F.col("width")))
    best = j.groupBy("id").agg(F.min(F.struct("o_w", F.col("o_s") * -1, "o_id")).alias("b")).select("id", F.col("b.o_id").alias("parent_scope"))
    return s.join(best, "id", "left")


def innermost(points: DataFrame, s: DataFrame) -> DataFrame:
    """The least scope around each (file_path, line)."""
    j = inside(points, s.select("id", "file_path", "start_line", "end_line", "width"), "file_path")
    return j.groupBy("file_path", "line").agg(F.min(F.struct("width", F.col("start_line") * -1, "id")).alias("b")).select("file_path", "line", F.col("b.id").alias("scope_id"))


def visible(df: DataFrame, points: DataFrame) -> DataFrame:
    """Names one may use at each (file_path, line): symbols of the file declared before it whose parent is open there, or
    that have none in the file."""
    d = df.select("id", "name", "file_path", "start_line", "end_line", "parent")
    open_ = d.select(F.col("id").alias("parent"), F.col("file_path").alias("pf"), F.col("start_line").alias("ps"), F.col("end_line").alias("pe"))
    j = points.join(d, "file_path").filter(F.col("start_line") <= F.col("line")).join(open_, "parent", "left")
    return j.filter(F.col("pf").isNull() | (F.col("pf") != F.col("file_path")) | F.col("line").between(F.col("ps"), F.col("pe"))).select("file_path", "line", "id", "name").distinct()


def resolve(df: DataFrame, i: DataFrame, qualified: str) -> DataFrame:
    """The definitions of A::b::c: the first name is a definition or an imported alias, each further one a member."""
    parts = [p for p in re.split(r"::|\.", qualified) if p]
    d = df.filter(~F.col("kind").isin("import", "variable")).select("id", "name", "parent")
    now = d.filter(F.col("name") == parts[0])
    alias = i.filter((F.col("imported_symbol") == parts[0])).select("imported_symbol").distinct()
    now = now.select("id").unionByName(d.join(alias.withColumnRenamed("imported_symbol", "name"), "name", "left_semi").select("id")).distinct()
    for p in parts[1:]:
        now = d.filter(F.col("name") == p).join(now.select(F.col("id").alias("parent")), "parent", "left_semi").select("id")
    return now


def not_builtin(r: DataFrame, language: str) -> DataFrame:
    """References without the language's built-in types."""
    return r.filter(~F.col("symbol_name").isin(BUILTINS.get(language, "").split()))


def java_equivalent(df: DataFrame) -> DataFrame:
    """(id, kotlin_type, java_type, java_id) of the types in Kotlin's return types: the Java type that stands for it and its
    first definition in Java, null where there is none. Types without a Java type (Unit, Nothing) have no row."""
    w = F.explode(F.array_distinct(F.regexp_extract_all("return_type", F.lit(r"([A-Za-z]\w*)"), F.lit(1)))).alias("kotlin_type")
    k = df.filter(F.col("language") == "kotlin").select("id", w).filter(~F.col("kotlin_type").isin(NO_JAVA_TYPE))
    k = k.select("id", "kotlin_type", F.coalesce(lang.lookup(KOTLIN_TO_JAVA, F.col("kotlin_type")), F.col("kotlin_type")).alias("java_type"))
    first = df.filter((F.col("language") == "java") & ~F.col("kind").isin("import", "variable")).groupBy(F.col("name").alias("java_type")).agg(F.min(F.struct("file_path", "start_line", "id")).alias("f"))
    return k.join(first, "java_type", "left").select("id", "kotlin_type", "java_type", F.col("f.id").alias("java_id"))


def doc_type(path: Column) -> Column:
    n = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(n.startswith("readme"), "readme").when(n.startswith("contributing"), "contributing").when(n.startswith("changelog"), "changelog").when(n.startswith("license"), "license").when(n.startswith("architecture"), "architecture").when(n.endswith(".md"), "other")


def config_type(path: Column) -> Column:
    n = F.element_at(F.split(path, "/"), -1)
    return F.when(n == "package.json", "npm").when(n == "Cargo.toml", "cargo").when(n == "Makefile", "make").when(n == "pyproject.toml", "python").when(n == "go.mod", "go").when(n == "pom.xml", "maven").when(n.startswith("build.gradle"), "gradle")


def config(path: str, text: str) -> tuple[list[str], list[str], list[str]] | None:
    """(build targets, test commands, run commands) of a configuration file; None if it is malformed or unknown."""
    name = path.rsplit("/", 1)[-1]
    try:
        if name == "package.json":
            t = json.loads(text)
            b, te, r = [], [], []
            for k, _ in (t.get("scripts") or {}).items():
                low = k.lower()
                if "build" in low or "compile" in low:
                    b.append(k)
                if "test" in low or low in ("jest", "mocha"):
                    te.append(f"npm run {k}")
                if low in ("start", "dev", "serve"):
                    r.append(f"npm run {k}")
            if t.get("main"):
                r.append(f"node {t['main']}")
            bins = t.get("bin")
            r += [f"npx {k}" for k in bins] if isinstance(bins, dict) else [f"node {bins}"] if bins else []
            return b, te, r
        if name == "Cargo.toml":
            import tomllib

            t = tomllib.loads(text)
            r = ["cargo run", *[f"cargo run --bin {x['name']}" for x in t.get("bin", [])], *[f"cargo run --example {x['name']}" for x in t.get("example", [])]]
            return ["build", *(["workspace"] if "workspace" in t else [])], ["cargo test"], r
        if name == "Makefile":
            found = [m[1] for m in re.finditer(r"(?m)^([A-Za-z0-9_][\w.-]*)\s*:(?!=)", text)]
            return [x for x in found if x in ("all", "build", "compile")], [f"make {x}" for x in found if "test" in x or x == "check"], [f"make {x}" for x in found if x in ("run", "start", "serve")]
        if name == "pyproject.toml":
            import tomllib

            t = tomllib.loads(text)
            tool = t.get("tool", {})
            scripts = {**(t.get("project") or {}).get("scripts", {}), **tool.get("poetry", {}).get("scripts", {})}
            return ["python -m build"], ["pytest"] if "pytest" in tool else [], sorted(scripts)
        if name == "go.mod" and re.search(r"(?m)^module ", text):
            return ["go build"], ["go test ./..."], ["go run ."]
    except (ValueError, TypeError, KeyError, AttributeError):
        return None
    return None


def configs(texts: DataFrame) -> DataFrame:
    """(path, config_type, build_targets, test_commands, run_commands) of configuration texts (path, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *c) for p, t in zip(b.column("path").to_pylist(), b.column("body").to_pylist(), strict=True) if (c := config(p, t)) is not None]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.string(), *[pa.list_(pa.string())] * 3], strict=True)], names=["path", "build_targets", "test_commands", "run_commands"])

    c = texts.filter("path is not null and body is not null").select("path", "body").mapInArrow(run, "path string, build_targets array<string>, test_commands array<string>, run_commands array<string>")
    return c.withColumn("config_type", config_type(F.col("path")))


def project_commands(projects: DataFrame) -> DataFrame:
    """(project_id, role, command): what the build tool of each project offers, distinct."""
    roles = F.array(*[F.struct(F.lit(r).alias("role"), lang.lookup({k: v[i] for k, v in TOOLS.items()}, F.col("ecosystem")).alias("command")) for i, r in enumerate(("build", "test", "run"))])
    return projects.select(F.col("id").alias("project_id"), F.explode(roles).alias("x")).select("project_id", "x.role", "x.command").filter("command is not null").distinct()


def profile(projects: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, build_tools, primary_language, languages): tools, and the languages of a project's files by count."""
    f = files.filter("path is not null and project_id is not null").select("project_id", "path", lang.language(F.col("language"), F.col("path")).alias("language")).distinct()
    n = f.filter("language is not null").groupBy("project_id", "language").agg(F.countDistinct("path").alias("n"))
    langs = n.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "language"))), lambda x: x["language"]), ",").alias("languages"))
    p = projects.groupBy(F.col("id").alias("project_id")).agg(F.array_join(F.array_sort(F.collect_set("ecosystem")), ",").alias("build_tools"), F.min("ecosystem").alias("e"))
    return p.join(langs, "project_id", "left").select("project_id", "build_tools", lang.lookup(PRIMARY, F.col("e")).alias("primary_language"), "languages")


def compass(df: DataFrame, projects: DataFrame) -> DataFrame:
    """The overview as rows (section, key, value): language shares, the largest modules and the build tools."""
    a = language_share(df).select(F.lit("language").alias("section"), F.col("language").alias("key"), F.col("symbols").alias("value"))
    m = directory_rollup(df).orderBy(F.desc("symbols"), "directory").limit(10).select(F.lit("module").alias("section"), F.col("directory").alias("key"), F.col("symbols").alias("value"))
    p = projects.distinct().groupBy(F.col("ecosystem").alias("key")).agg(F.count("*").alias("value")).select(F.lit("build_tool").alias("section"), "key", "value")
    return a.unionByName(m).unionByName(p)


def expand_node(nodes: DataFrame, df: DataFrame, node: str, size: int = 20) -> DataFrame:
    """A page of a node's content: child nodes, then files with their number of symbols."""
    children = nodes.filter(F.col("parent_id") == node).select(F.lit(0).alias("o"), F.lit("node").alias("part"), F.col("id").alias("key"), F.lit(None).cast("long").alias("symbols"))
    files = df.filter(F.concat(F.lit("dir:"), directory(F.col("file_path"))) == node).groupBy(F.col("file_path").alias("key")).agg(F.count("*").alias("symbols")).select(F.lit(1).alias("o"), F.lit("file").alias("part"), "key", "symbols")
    return children.unionByName(files).orderBy("o", "key").limit(size).select("part", "key", "symbols")


def coverage(df: DataFrame, r: DataFrame, i: DataFrame) -> DataFrame:
    """Which layers a collected context covers, and whether the needed ones are all there."""
    any_ = lambda d, c: d.agg(F.coalesce(F.bool_or(c), F.lit(False)).alias("x"))
    m = any_(df, F.col("kind") == "module").withColumnRenamed("x", "module_graph")
    s = any_(df, F.col("kind").isin(FUNCTION_KINDS + TYPE_KINDS)).withColumnRenamed("x", "symbol_graph")
    g = any_(i, F.col("imported_path").isNotNull()).withColumnRenamed("x", "import_graph")
    c = any_(r, F.col("reference_kind") == "call").withColumnRenamed("x", "call_graph")
    return m.crossJoin(s).crossJoin(g).crossJoin(c).withColumn("complete", F.col("module_graph") & F.col("symbol_graph") & F.col("import_graph"))


def important_files(roots: DataFrame, files: DataFrame) -> DataFrame:
    """(root, path) of the important files that exist; `roots` has a row for each project (root, no slash at its end)."""
    wanted = roots.select("root").distinct().select("root", F.explode(F.array(*map(F.lit, IMPORTANT))).alias("name")).select("root", F.concat("root", F.lit("/"), "name").alias("path"))
    return wanted.join(files.select("path").distinct(), "path", "left_semi").select("root", "path")


def _made(s, d):
    """Configuration texts made of the projects' names, one of each kind."""
    p = table(s, d, "projects").select("id").distinct()
    forms = [("package.json", "concat('{\"scripts\": {\"build\": \"b\", \"test:', id, '\": \"t\", \"dev\": \"d\"}, \"main\": \"m', id, '.js\"}')"), ("Cargo.toml", "concat('[package]', char(10), 'name = \"a\"', char(10), '[[bin]]', char(10), 'name = \"b', id, '\"')"), ("Makefile", "concat('all: x', char(10), 'test', id, ':', char(10), 'run:')"), ("go.mod", "concat('module m', id)"), ("pyproject.toml", "'[tool.pytest]'"), ("bad/package.json", "'{'")]
    return p.select("id", F.explode(F.array(*[F.struct(F.concat(F.lit("p"), "id", F.lit(f"/{n}")).alias("path"), F.expr(x).alias("body")) for n, x in forms])).alias("x")).select("x.path", "x.body")


def _flat(c: DataFrame) -> DataFrame:
    return c.select("path", "config_type", *[F.array_join(x, ",").alias(x) for x in ("build_targets", "test_commands", "run_commands")])


def _sc(s, d):
    return symbols(s, d, ["id", "name", "kind", "file_path", "start_line", "end_line", "parent"])


def _points(s, d):
    """Every line with a reference."""
    return refs(s, d).select(F.col("referenced_in_file").alias("file_path"), "line").distinct()


NODE = "dir:larch-marker/manifestkit-2/src"
_W = f"WITH {SYM} "
_SK = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SCOPE_KINDS.items()) + " END"
_T = "('" + "','".join(TYPE_KINDS) + "')"
_NODES = "n AS (SELECT id, parent_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM project_nodes WHERE id IS NOT NULL) WHERE rn = 1)"
_FLANG = "coalesce(" + f"CASE nullif(lower(trim(language)), '') {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in lang.ALIASES.items())} ELSE nullif(lower(trim(language)), '') END" + f", CASE lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1)) {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in lang.EXTENSIONS.items())} END)"
_CMD = " UNION ALL ".join(f"SELECT id, '{r}' AS role, CASE ecosystem {' '.join(f'WHEN {k!r} THEN {v[i]!r}' for k, v in TOOLS.items())} END AS command FROM projects" for i, r in enumerate(("build", "test", "run")))
_LI = "d AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL), li AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1)::INT AS n FROM d)"
QUERIES = {
    "scope_tree": lambda s, d: scopes(_sc(s, d)).select("id", "parent_scope", "scope_kind", "name", "file_path", "start_line", "end_line"),
    "innermost_scope": lambda s, d: innermost(_points(s, d), scopes(bound_symbols(s, d))),
    "visible_symbols": lambda s, d: visible(_sc(s, d), s.createDataFrame([("larch-marker/manifestkit-2/tests/token/span_frame.java", 30)], "file_path string, line int")).select("id", "name"),
    "resolve_qualified": lambda s, d: resolve(_sc(s, d), imports(s, d), "DigestShard::matchEdge"),
    "references_without_builtins": lambda s, d: not_builtin(refs(s, d), "rust").groupBy("reference_kind").agg(F.count("*").alias("n")),
    "java_equivalents": lambda s, d: java_equivalent(symbols(s, d, ["id", "name", "kind", "file_path", "start_line", "language", "return_type"])),
    "document_types": lambda s, d: table(s, d, "documents").filter("path is not null").select("doc_id", doc_type(F.col("path")).alias("doc_type")),
    "config_digests": lambda s, d: _flat(configs(_made(s, d))),
    "project_commands": lambda s, d: project_commands(table(s, d, "projects")),
    "project_profile": lambda s, d: profile(table(s, d, "projects"), table(s, d, "files")),
    "project_compass": lambda s, d: compass(symbols(s, d, ["id", "kind", "file_path", "language", "visibility"]), table(s, d, "projects")),
    "expand_project_node": lambda s, d: expand_node(table(s, d, "project_nodes").groupBy("id").agg(F.max(F.struct("updated_at", "parent_id")).alias("v")).select("id", "v.parent_id"), symbols(s, d, ["id", "file_path"]), NODE),
    "context_coverage": lambda s, d: coverage(bound_symbols(s, d), refs(s, d), imports(s, d)),
    "important_files": lambda s, d: important_files(table(s, d, "projects").select(F.regexp_extract("manifest_path", "^(.*)/[^/]*$", 1).alias("root")), table(s, d, "projects").select(F.col("manifest_path").alias("path")).union(table(s, d, "files").select("path"))),
    "doc_command_languages": lambda s, d: code_blocks(table(s, d, "documents"), "doc_id", "text").groupBy("language").agg(F.count("*").alias("blocks"), F.count_if(F.col("language").isin(SHELLS)).alias("commands")),
}
ORACLES = {
    "scope_tree": _W + f", s AS (SELECT *, {_SK} AS scope_kind, end_line - start_line AS width FROM sym WHERE {_SK} IS NOT NULL AND end_line >= start_line) SELECT id, (SELECT o.id FROM s o WHERE o.file_path = s.file_path AND o.start_line <= s.start_line AND o.end_line >= s.end_line AND o.width > s.width ORDER BY o.width, o.start_line DESC, o.id LIMIT 1) AS parent_scope, scope_kind, name, file_path, start_line, end_line FROM s",
    "innermost_scope": f"WITH {REFS_CTE}, p AS (SELECT DISTINCT referenced_in_file AS file_path, line FROM refs) SELECT file_path, line, id AS scope_id FROM (SELECT p.file_path, p.line, b.id, row_number() OVER (PARTITION BY p.file_path, p.line ORDER BY b.end_line - b.start_line, b.start_line DESC, b.id) AS rn FROM p JOIN bsym b ON b.file_path = p.file_path AND p.line BETWEEN b.start_line AND b.end_line) WHERE rn = 1",
    "visible_symbols": _W + "SELECT DISTINCT s.id, s.name FROM sym s LEFT JOIN sym o ON o.id = s.parent WHERE s.file_path = 'larch-marker/manifestkit-2/tests/token/span_frame.java' AND s.start_line <= 30 AND (o.id IS NULL OR o.file_path <> s.file_path OR 30 BETWEEN o.start_line AND o.end_line)",
    "resolve_qualified": _W + "SELECT id FROM sym WHERE name = 'matchEdge' AND kind NOT IN ('import','variable') AND parent IN (SELECT id FROM sym WHERE name = 'DigestShard' AND kind NOT IN ('import','variable'))",
    "references_without_builtins": f"WITH {REFS_CTE} SELECT reference_kind, count(*) AS n FROM refs WHERE symbol_name NOT IN ('i8', 'i16', 'i32', 'i64', 'i128', 'isize', 'u8', 'u16', 'u32', 'u64', 'u128', 'usize', 'f32', 'f64', 'bool', 'char', 'str', 'String', 'Self', 'self', 'Vec', 'Option', 'Result', 'Box', 'Rc', 'Arc', 'Cell', 'RefCell', 'Ok', 'Err', 'Some', 'None') GROUP BY 1",
    "java_equivalents": _W + ", k AS (SELECT id, k AS kotlin_type, CASE k WHEN 'Int' THEN 'Integer' WHEN 'Char' THEN 'Character' WHEN 'Any' THEN 'Object' ELSE k END AS java_type FROM (SELECT id, unnest(list_distinct(regexp_extract_all(return_type, '([A-Za-z]\\w*)', 1))) AS k FROM sym WHERE language = 'kotlin') WHERE k NOT IN ('Unit', 'Nothing')), j AS (SELECT name, arg_min(id, (file_path, start_line, id)) AS java_id FROM sym WHERE language = 'java' AND kind NOT IN ('import', 'variable') GROUP BY 1) SELECT k.id, kotlin_type, java_type, java_id FROM k LEFT JOIN j ON j.name = k.java_type",
    "document_types": "SELECT doc_id, CASE WHEN n LIKE 'readme%' THEN 'readme' WHEN n LIKE 'contributing%' THEN 'contributing' WHEN n LIKE 'changelog%' THEN 'changelog' WHEN n LIKE 'license%' THEN 'license' WHEN n LIKE 'architecture%' THEN 'architecture' WHEN n LIKE '%.md' THEN 'other' END AS doc_type FROM (SELECT doc_id, lower(string_split(path, '/')[-1]) AS n FROM documents WHERE path IS NOT NULL)",
    "config_digests": "WITH p AS (SELECT DISTINCT id FROM projects) " + " UNION ALL ".join(f"SELECT concat('p', id, '/{n}') AS path, '{t}' AS config_type, {b} AS build_targets, {te} AS test_commands, {r} AS run_commands FROM p" for n, t, b, te, r in [("package.json", "npm", "'build'", "concat('npm run test:', id)", "concat('npm run dev,node m', id, '.js')"), ("Cargo.toml", "cargo", "'build'", "'cargo test'", "concat('cargo run,cargo run --bin b', id)"), ("Makefile", "make", "'all'", "concat('make test', id)", "'make run'"), ("go.mod", "go", "'go build'", "'go test ./...'", "'go run .'"), ("pyproject.toml", "python", "'python -m build'", "'pytest'", "''")]),
    "project_commands": f"SELECT DISTINCT id AS project_id, role, command FROM ({_CMD}) WHERE command IS NOT NULL",
    "project_profile": f"WITH f AS (SELECT DISTINCT project_id, path, {_FLANG} AS language FROM files WHERE path IS NOT NULL AND project_id IS NOT NULL), c AS (SELECT project_id, language, count(DISTINCT path) AS n FROM f WHERE language IS NOT NULL GROUP BY 1, 2), l AS (SELECT project_id, string_agg(language, ',' ORDER BY n DESC, language) AS languages FROM c GROUP BY 1) SELECT p.id AS project_id, string_agg(DISTINCT ecosystem, ',' ORDER BY ecosystem) AS build_tools, CASE min(ecosystem) {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in PRIMARY.items())} END AS primary_language, any_value(languages) AS languages FROM projects p LEFT JOIN l ON l.project_id = p.id GROUP BY p.id",
    "project_compass": _W + f"SELECT 'language' AS section, language AS key, count(*) AS value FROM sym GROUP BY 2 UNION ALL (SELECT 'module', regexp_extract(file_path, '^(.*)/[^/]*$', 1), count(*) FROM sym WHERE kind IN ('function','method') OR kind IN {_T} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10) UNION ALL SELECT 'build_tool', ecosystem, count(*) FROM (SELECT DISTINCT * FROM projects) GROUP BY 2",
    "expand_project_node": _W + f", {_NODES} SELECT part, key, symbols FROM (SELECT 0 AS o, 'node' AS part, id AS key, NULL::BIGINT AS symbols FROM n WHERE parent_id = '{NODE}' UNION ALL SELECT 1, 'file', file_path, count(*) FROM sym WHERE concat('dir:', regexp_extract(file_path, '^(.*)/[^/]*$', 1)) = '{NODE}' GROUP BY file_path) ORDER BY o, key LIMIT 20",
    "context_coverage": f"WITH {REFS_CTE}, {IMPORTS_CTE} SELECT (SELECT coalesce(bool_or(kind = 'module'), FALSE) FROM bsym) AS module_graph, (SELECT count(*) > 0 FROM bsym) AS symbol_graph, (SELECT count(imported_path) > 0 FROM imports) AS import_graph, (SELECT count(*) FILTER (reference_kind = 'call') > 0 FROM refs) AS call_graph, (SELECT coalesce(bool_or(kind = 'module'), FALSE) AND count(*) > 0 FROM bsym) AND (SELECT count(imported_path) > 0 FROM imports) AS complete",
    "important_files": "SELECT DISTINCT p.root, f.path FROM (SELECT regexp_extract(manifest_path, '^(.*)/[^/]*$', 1) AS root FROM projects) p JOIN (SELECT path FROM files UNION SELECT manifest_path FROM projects) f ON starts_with(f.path, concat(p.root, '/')) AND substr(f.path, length(p.root) + 2) IN ('README.md', 'README', 'CLAUDE.md', 'AGENTS.md', 'Cargo.toml', 'package.json', 'build.gradle.kts', 'build.gradle', 'pom.xml', 'src/lib.rs', 'src/main.rs', 'src/index.ts', 'tsconfig.json', '.env.example', 'docker-compose.yml', 'Dockerfile')",
    "doc_command_languages": f"WITH {_LI}, f AS (SELECT *, sum(CASE WHEN starts_with(ltrim(line, ' '), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS k, sum(CASE WHEN starts_with(ltrim(line, ' '), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS z FROM li), b AS (SELECT nullif(regexp_extract(ltrim(arg_min(line, n), ' '), '^`+\\s*(\\S*)', 1), '') AS language FROM f WHERE k % 2 = 1 AND k < z GROUP BY doc_id, k) SELECT language, count(*) AS blocks, count(*) FILTER (language IN ('bash', 'sh', 'shell', 'zsh', 'console', 'terminal', 'cmd', 'powershell', 'ps1')) AS commands FROM b GROUP BY 1",
}
