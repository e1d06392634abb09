"""Source texts to symbols, references, imports and scopes, and manifests to projects and dependencies.

Python is parsed by the standard library's own parser; the other languages by rule tables: patterns for declarations,
imports and calls on text whose comments and strings are blanked out, with block ends found by their brackets. One
narrow pass over (path, body, language) gives rows of one wide schema, which the three tables are selected from.
"""

from __future__ import annotations

import ast
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import lang
from codeloom.sources.signatures import with_parts
from codeloom.sources.tables import latest, table

ROW = "path string, language string, what string, name string, kind string, start_line int, end_line int, visibility string, signature string, parent string, doc_comment string"
_NAMES = [x.split()[0] for x in ROW.split(", ")]
# Built-in types, never references.
BUILTINS = {
    "rust": "i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 bool char str String Self self Vec Option Result Box Rc Arc Cell RefCell Ok Err Some None",
    "java": "int long short byte float double boolean char void Int Long Short Byte Float Double Boolean Char String Object Unit Any Nothing",
    "kotlin": "int long short byte float double boolean char void Int Long Short Byte Float Double Boolean Char String Object Unit Any Nothing",
    "typescript": "string number boolean void null undefined any unknown never object symbol bigint String Number Boolean Array Object Promise",
}
# Declarations by language: (kind, pattern with the name as its first group). `{` or an indented block follows.
RULES: dict[str, list[tuple[str, str]]] = {
    "rust": [("function", r"\bfn\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("trait", r"\btrait\s+(\w+)"), ("module", r"\bmod\s+(\w+)"), ("constant", r"\bconst\s+([A-Z_]\w*)\s*:"), ("type_alias", r"\btype\s+(\w+)\s*="), ("variable", r"\blet\s+(?:mut\s+)?(\w+)")],
    "java": [("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("method", r"(?m)^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ?]+\s+(\w+)\s*\("), ("variable", r"(?m)^[ \t]+(?:final\s+)?(?:int|long|String|double|boolean|var)\s+(\w+)\s*=")],
    "kotlin": [("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("class", r"\bobject\s+(\w+)"), ("function", r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(\w+)\s*\("), ("variable", r"\bva[lr]\s+(\w+)")],
    "typescript": [("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("type_alias", r"\btype\s+(\w+)\s*="), ("function", r"\bfunction\s*\*?\s*(\w+)"), ("method", r"(?m)^[ \t]+(?:(?:public|private|protected|static|async)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b)(\w+)\s*\([^()]*\)\s*(?::[^{;=]+)?\{"), ("constant", r"\bconst\s+(\w+)"), ("variable", r"\b(?:let|var)\s+(\w+)")],
    "go": [("function", r"(?m)^func\s+(\w+)"), ("method", r"(?m)^func\s+\([^)]*\)\s*(\w+)"), ("struct", r"\btype\s+(\w+)\s+struct"), ("interface", r"\btype\s+(\w+)\s+interface"), ("constant", r"(?m)^const\s+(\w+)"), ("variable", r"(?m)^\s*(\w+)\s*:=")],
    "cpp": [("class", r"\bclass\s+(\w+)\s*[:{]"), ("struct", r"\bstruct\s+(\w+)\s*[:{]"), ("enum", r"\benum\s+(?:class\s+)?(\w+)"), ("module", r"\bnamespace\s+(\w+)"), ("function", r"(?m)^[ \t]*(?!return\b|else\b|if\b|for\b|while\b|switch\b)(?:[\w:<>,&*]+[ \t]+)+[&*]*([\w:~]+)\s*\([^;{}()]*\)[^;{}=]*\{")],
    "csharp": [("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("module", r"\bnamespace\s+([\w.]+)"), ("method", r"(?m)^[ \t]*(?:(?:public|private|protected|internal|static|virtual|override|async)\s+)+[\w<>\[\],?]+\s+(\w+)\s*\(")],
    "lua": [("function", r"\bfunction\s+([\w.:]+)"), ("variable", r"\blocal\s+(\w+)\s*=")],
    "swift": [("function", r"\bfunc\s+(\w+)"), ("class", r"\bclass\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("interface", r"\bprotocol\s+(\w+)")],
    "bash": [("function", r"(?m)^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{"), ("variable", r"(?m)^\s*(?:export\s+)?([A-Z_]\w*)=")],
    "sql": [("struct", r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?([\w.]+)"), ("function", r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:function|procedure)\s+([\w.]+)")],
    "haskell": [("function", r"(?m)^(\w+)\s*::"), ("struct", r"(?m)^(?:data|newtype)\s+(\w+)"), ("trait", r"(?m)^class\s+(?:.*=>\s*)?(\w+)")],
    "elixir": [("module", r"\bdefmodule\s+([\w.]+)"), ("function", r"\bdefp?\s+(\w+[?!]?)")],
    "hcl": [("struct", r"(?m)^(?:resource|data)\s+\"[\w-]+\"\s+\"([\w-]+)\""), ("variable", r"(?m)^variable\s+\"([\w-]+)\""), ("module", r"(?m)^module\s+\"([\w-]+)\"")],
    "yaml": [("field", r"(?m)^([\w.-]+)\s*:")],
    "toml": [("module", r"(?m)^\[+([\w.-]+)\]+"), ("field", r"(?m)^([\w-]+)\s*=")],
}
# Words that open and close blocks, where no braces do.
WORD_BLOCKS = {"lua": r"\b(?:(?P<open>function|if|do|repeat)|(?P<close>end|until))\b"}
IMPORTS = {
    "rust": r"\buse\s+([\w:]+(?:::\{[^}]*\}|::\*)?)", "java": r"\bimport\s+(?:static\s+)?([\w.*]+);", "kotlin": r"(?m)^import\s+([\w.*]+)", "typescript": r"\bimport\b[^;\n]*?from\s*[\"']([^\"']+)[\"']", "go": r"\bimport\s+(?:\w+\s+)?\"([^\"]+)\"",
    "cpp": r"(?m)^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", "csharp": r"(?m)^using\s+([\w.]+);", "lua": r"\brequire\s*\(?\s*[\"']([^\"']+)[\"']", "swift": r"(?m)^import\s+(\w+)", "bash": r"(?m)^\s*(?:source|\.)\s+(\S+)", "haskell": r"(?m)^import\s+(?:qualified\s+)?([\w.]+)", "elixir": r"(?m)^\s*(?:import|alias|use)\s+([\w.]+)",
}
_BLANK = {"hash": r"#[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", "dash": r"--\[\[.*?\]\]|--[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", "slash": r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`"}
_STYLE = {"bash": "hash", "yaml": "hash", "toml": "hash", "hcl": "hash", "elixir": "hash", "lua": "dash", "sql": "dash", "haskell": "dash"}
CALL = re.compile(r"\b([A-Za-z_]\w*)\s*(?:!\s*)?\(")
TYPE_USE = re.compile(r"(?::\s*&?(?:mut\s+)?|\bnew\s+|->\s*|<\s*)([A-Z]\w*)")
EXTENDS = re.compile(r"\b(?:extends|implements)\s+([A-Z]\w*)|\bimpl(?:<[^>]*>)?\s+([A-Z]\w*)\s+for\b|\bclass\s+\w+[^{:\n]*:\s*(?:public\s+)?([A-Z]\w*)")
KEYWORDS = frozenset("if for while switch catch return function match loop fn def elif else do try with assert print in and or not new sizeof typeof await yield super this self when until".split())


def visibility(language: str, line: str, name: str) -> str | None:
    """As the language spells it; None where the spelling says nothing."""
    head = line.strip()
    if language == "rust":
        return "public" if re.match(r"pub\s", head) else "internal" if head.startswith("pub(crate)") else None if head.startswith("pub(") else "private"
    if language == "go":
        return "public" if name[:1].isupper() else "private"
    if language == "python":
        return "private" if name.startswith("_") and not name.endswith("__") else "public"
    m = re.match(r"(?:export\s+)?(?:\w+\s+)*?(public|private|protected|internal)\b", head)
    if m:
        return m[1]
    return "public" if language == "kotlin" or head.startswith("export") else None


def _header(lines: list[str], node: ast.AST) -> str:
    """The whole header of a Python definition, on however many lines, in one line and without its colon."""
    first = node.body[0]
    stop = min(first.lineno, *[d.lineno for d in getattr(first, "decorator_list", [])] or [first.lineno])
    text = lines[node.lineno - 1 : stop - 1] if stop > node.lineno else [lines[node.lineno - 1].encode()[: first.col_offset].decode("utf-8", "ignore")]
    text = [re.sub(r"\s#.*$", "", x) for x in text]
    return re.sub(r"\s+", " ", " ".join(text)).strip().rstrip(":").strip()


def _documentation(lines: list[str], at: int) -> str | None:
    """The documenting comment right above a line: '///' or '//!' lines, or a block from '/**'; attributes may lie between."""
    i = at - 2
    while i >= 0 and lines[i].strip().startswith(("@", "#[", "[")):
        i -= 1
    if i < 0:
        return None
    end = i
    if lines[i].strip().startswith(("///", "//!")):
        while i > 0 and lines[i - 1].strip().startswith(("///", "//!")):
            i -= 1
    elif lines[i].strip().endswith("*/"):
        while i >= 0 and "/*" not in lines[i]:
            i -= 1
        if i < 0 or not lines[i].strip().startswith("/**"):
            return None
    else:
        return None
    return "\n".join(x.strip() for x in lines[i : end + 1])


def _header_end(code: str, at: int) -> int:
    """Where a header ends that has its name before `at`: at the block, the semicolon, or the line end outside of brackets
    unless the next line goes on with it."""
    depth = 0
    for i in range(at, len(code)):
        c = code[i]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth <= 0 and (c in "{;" or (c == "=" and code[i + 1 : i + 2] not in ("=", ">"))):
            return i
        elif c == "\n" and depth <= 0 and not re.search(r"(?:,|\bwhere)[ \t]*$", code[max(0, i - 40) : i]) and not re.match(r"\s*(?:[{:]|->|where\b|throws\b|const\b|noexcept\b|override\b)", code[i:]):
            return i
    return len(code)


def _python(body: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(body)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    lines = body.splitlines()
    stack: list[tuple] = [(tree, None, False)]
    while stack:
        node, parent, in_class = stack.pop()
        for child in ast.iter_child_nodes(node):
            inside, owner = False, parent
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                yield "symbol", child.name, "method" if in_class else "function", child.lineno, child.end_lineno, visibility("python", "", child.name), _header(lines, child), parent, ast.get_docstring(child, clean=False)
                owner = child.name
            elif isinstance(child, ast.ClassDef):
                yield "symbol", child.name, "class", child.lineno, child.end_lineno, visibility("python", "", child.name), _header(lines, child), parent, ast.get_docstring(child, clean=False)
                for b in child.bases:
                    if (n := getattr(b, "id", getattr(b, "attr", None))) is not None:
                        yield "reference", n, "extend", b.lineno, b.lineno, None, None, child.name
                inside, owner = True, child.name
            elif isinstance(child, ast.Import | ast.ImportFrom):
                module = getattr(child, "module", None)
                for a in child.names:
                    yield "import", ".".join(x for x in ("." * (getattr(child, "level", 0) or 0) + (module or ""), a.name) if x), "wildcard" if a.name == "*" else "symbol" if module else "module", child.lineno, child.lineno, None, None, None
            elif isinstance(child, ast.Call):
                f = child.func
                if (n := getattr(f, "id", getattr(f, "attr", None))) is not None:
                    yield "reference", n, "call", child.lineno, child.lineno, None, None, parent
            elif isinstance(child, ast.Assign | ast.AnnAssign) and parent is None:
                for t in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(t, ast.Name):
                        yield "symbol", t.id, "constant" if t.id.isupper() else "variable", child.lineno, child.end_lineno, visibility("python", "", t.id), None, None
            stack.append((child, owner, inside))


def _rules(body: str, language: str) -> Iterator[tuple]:
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    code = re.sub(_BLANK[_STYLE.get(language, "slash")], blank, body, flags=re.S)
    starts = [0, *(m.end() for m in re.finditer("\n", body))]
    line = lambda at: bisect_right(starts, at)
    opened, ends = [], {}
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            ends[opened.pop()] = m.start()
    if language in WORD_BLOCKS:  # blocks between words
        opened = []
        for m in re.finditer(WORD_BLOCKS[language], code):
            if m.lastgroup == "open":
                opened.append(m.start())
            elif opened:
                ends[opened.pop()] = m.start()
    spans: list[tuple[int, int, str, str]] = []
    found: list[tuple] = []
    lines = body.split("\n")
    source = body if language == "hcl" else code
    for kind, pattern in RULES[language]:
        for m in re.finditer(pattern, source):
            end_of_line = code.find("\n", m.start(1))
            brace = code.find("{", m.start(1))
            stop = min((x for x in (code.find(";", m.start(1)),) if x >= 0), default=len(code))
            if language in WORD_BLOCKS and kind == "function":
                brace, stop = m.start(), len(code) + 1
            block = brace if kind not in ("variable", "constant", "type_alias", "field") and 0 <= brace < stop else None
            a, b = line(m.start(1)), line(ends.get(block, end_of_line if end_of_line >= 0 else len(code))) if block is not None else line(m.start(1))
            text = body[starts[a - 1] : starts[a] if a < len(starts) else len(body)]
            head = body[starts[a - 1] : _header_end(code, m.end(1))] if kind in ("function", "method") else text.split("{")[0]
            spans.append((a, b, m[1], kind))
            found.append(("symbol", re.split(r"[.:]+", m[1])[-1] if language == "lua" else m[1], kind, a, b, visibility(language, text, m[1]), re.sub(r"\s+", " ", head).strip() or None, None, _documentation(lines, a)))
    # A function inside a type, or a block that implements one, is a method.
    blocks = [(a, b) for a, b, _, k in spans if k in ("class", "struct", "trait", "interface", "enum") and b > a] + [(line(m.start()), line(ends[m.end() - 1])) for m in re.finditer(r"(?m)^[ \t]*(?:unsafe[ \t]+)?impl\b[^{};]*\{", code) if language == "rust" and m.end() - 1 in ends]
    found = [(*x[:2], "method", *x[3:]) if x[2] == "function" and any(a < x[3] <= b or a <= x[3] < b for a, b in blocks) else x for x in found]
    # A type of the same name and span goes before its alias.
    concrete = {x[1:2] + x[3:5] for x in found if x[2] != "type_alias"}
    yield from (x for x in found if x[2] != "type_alias" or x[1:2] + x[3:5] not in concrete)
    owners = sorted(((b - a, a, b, n) for a, b, n, k in spans if k in ("function", "method", "class", "struct", "trait", "interface")))
    inside = lambda at: next((n for _, a, b, n in owners if a <= at <= b), None)
    if language in IMPORTS:
        for m in re.finditer(IMPORTS[language], body):
            p = m[1].strip()
            yield "import", p, "wildcard" if p.endswith("*") else "module" if re.search(r"::|\.|/", p) else "symbol", line(m.start()), line(m.start()), None, None, None
    declared = {(a, n) for a, _, n, _ in spans}
    builtin = frozenset(BUILTINS.get(language, "").split())
    for kind, pattern in (("call", CALL), ("type_use", TYPE_USE), ("extend", EXTENDS)):
        for m in pattern.finditer(code):
            n = next(x for x in m.groups() if x)
            at = line(m.start())
            if n not in KEYWORDS and n not in builtin and (at, n) not in declared:
                yield "reference", n, kind, at, at, None, None, inside(at)


def extract(body: str, language: str | None) -> list[tuple]:
    """(what, name, kind, start, end, visibility, signature, parent, and for symbols doc_comment) of a text; nothing for an unknown language."""
    text = re.sub(r"\r\n?", "\n", body.lstrip("﻿"))
    if language == "python":
        return list(_python(text))
    return list(_rules(text, language)) if language in RULES else []


def extract_all(sources: DataFrame) -> DataFrame:
    """All rows of all texts: sources is (path, body, language)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, lg, *r, *[None] * (len(_NAMES) - 2 - len(r))) for p, t, lg in zip(*(b.column(c).to_pylist() for c in ("path", "body", "language")), strict=True) for r in extract(t, lg)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
            types = [pa.int32() if n.endswith("_line") else pa.string() for n in _NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=_NAMES)

    return sources.filter("path is not null and body is not null").select("path", "body", "language").mapInArrow(run, ROW)


def with_language(sources: DataFrame, files: DataFrame) -> DataFrame:
    named = latest(files.filter(F.trim("language") != ""), "path", "indexed_at", ["path", "indexed_at", "language"]).select("path", "language")
    return sources.select("path", "body").distinct().join(named, "path", "left").withColumn("language", lang.language(F.col("language"), F.col("path")))


# Sections of a Cargo manifest that hold dependencies, and whether they are for development.
CARGO_SECTIONS = {"dependencies": False, "dev-dependencies": True, "build-dependencies": True}
NPM_SECTIONS = {"dependencies": False, "peerDependencies": False, "optionalDependencies": False, "devDependencies": True}


def manifest(name: str, text: str) -> list[tuple]:
    """(project, version, ecosystem, dependency, dependency_version, is_dev) of a manifest; nothing if it is malformed."""
    out: list[tuple] = []
    try:
        if name.endswith("Cargo.toml"):
            import tomllib

            t = tomllib.loads(text)
            project, version = t["package"]["name"], t["package"].get("version")
            for section, dev in CARGO_SECTIONS.items():
                for k, v in (t.get(section) or {}).items():
                    out.append((project, version, "cargo", k, v if isinstance(v, str) else v.get("version", "*"), dev))
        elif name.endswith("package.json"):
            t = json.loads(text)
            project, version = t["name"], t.get("version")
            for section, dev in NPM_SECTIONS.items():
                out += [(project, version, "npm", k, str(v), dev) for k, v in (t.get(section) or {}).items()]
        elif name.endswith("pyproject.toml"):
            import tomllib

            t = tomllib.loads(text)
            p = t.get("project") or t.get("tool", {}).get("poetry") or {}
            project, version = p["name"], p.get("version")
            for d in p.get("dependencies", []) if isinstance(p.get("dependencies", []), list) else []:
                m = re.match(r"([\w.-]+)\s*(.*)", d)
                out.append((project, version, "pypi", m[1], m[2] or "*", False))
        elif name.endswith("go.mod"):
            m = re.search(r"(?m)^module\s+(\S+)", text)
            project, version = m[1], None
            out += [(project, None, "go", a, b, False) for a, b in re.findall(r"(?m)^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+(v\S+)", text)]
        elif name.endswith(("build.gradle", "build.gradle.kts")):
            project, version = name.split("/")[-2] if "/" in name else "", None
            out += [(project, None, "gradle", f"{g}:{a}", v or "*", k.startswith("test")) for k, g, a, v in re.findall(r"(\w*[iI]mplementation|api)\s*\(?[\"']([\w.-]+):([\w.-]+):?([\w.-]*)[\"']", text)]
        elif name.endswith("pom.xml"):
            project = (re.search(r"<artifactId>([^<]+)</artifactId>", text) or ["", ""])[1]
            for d in re.findall(r"<dependency>(.*?)</dependency>", text, re.S):
                get = lambda k: (m[1] if (m := re.search(rf"<{k}>([^<]+)</{k}>", d)) else None)  # noqa: B023, E731
                out.append((project, None, "maven", f"{get('groupId')}:{get('artifactId')}", get("version") or "*", get("scope") == "test"))
    except (ValueError, KeyError, TypeError, AttributeError):
        return []
    return out


MANIFEST = "path string, project string, version string, ecosystem string, dependency string, dependency_version string, is_dev boolean"


def manifests(texts: DataFrame) -> DataFrame:
    """The dependencies of manifest texts (path, body)."""
    names = [x.split()[0] for x in MANIFEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *r) for p, t in zip(b.column("path").to_pylist(), b.column("body").to_pylist(), strict=True) for r in manifest(p, t)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.bool_() if n == "is_dev" else pa.string()) for c, n in zip(cols, names, strict=True)], names=names)

    return texts.filter("path is not null and body is not null").select("path", "body").mapInArrow(run, MANIFEST)


def workspace_kind(names: list[str], texts: dict[str, str]) -> str:
    """The kind of a workspace by its manifests, in the order in which they are asked."""
    if "[workspace]" in texts.get("Cargo.toml", ""):
        return "cargo"
    if "settings.gradle" in names or "settings.gradle.kts" in names:
        return "gradle"
    if '"workspaces"' in texts.get("package.json", ""):
        return "npm"
    if "pnpm-workspace.yaml" in names:
        return "pnpm"
    return "maven" if "<modules>" in texts.get("pom.xml", "") else "single"


def _all(s, d):
    return extract_all(with_language(table(s, d, "sources"), table(s, d, "files")))


def _projects(s, d):
    """Manifests made of the dependency table, one per project, so that they can be read back."""
    dep = table(s, d, "dependencies").filter("project_id is not null and name is not null").groupBy("project_id", "name").agg(F.max("version").alias("version"), F.bool_or("is_dev").alias("is_dev"))
    line = lambda dev: F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_dev") == dev, F.concat(F.lit('"'), "name", F.lit('": "'), F.coalesce("version", F.lit("*")), F.lit('"'))))), ", "), F.lit("}"))
    return dep.groupBy("project_id").agg(line(False).alias("a"), line(True).alias("b")).select(F.concat(F.lit("p"), "project_id", F.lit("/package.json")).alias("path"), F.concat(F.lit('{"name": "p'), "project_id", F.lit('", "dependencies": '), "a", F.lit(', "devDependencies": '), "b", F.lit("}")).alias("body"))


def with_signatures(rows: DataFrame) -> DataFrame:
    """Extracted functions and methods with the parts of their headers."""
    f = rows.filter("what = 'symbol' and kind in ('function', 'method')").withColumn("key", F.concat_ws("\1", "path", "start_line", "name"))
    return f.join(with_parts(f, "key").dropDuplicates(["key"]), "key", "left").drop("key", "what")


def agreement(s, d) -> DataFrame:
    """(language, symbols, found, same_kind, same_span, same_params, same_return): the valid symbols of the index that are
    functions or methods of a text, and how the functions extracted from that text agree with them, by path, name and line."""
    from codeloom.plans.index import symbols

    mine = with_signatures(_all(s, d)).groupBy("path", "name", "start_line").agg(F.max("kind").alias("k"), F.max("end_line").alias("e"), F.max(F.transform("params", lambda x: x["name"])).alias("p"), F.max("return_type").alias("r"))
    v = symbols(s, d, ["id", "file_path", "name", "kind", "language", "start_line", "end_line", "return_type"]).filter("kind in ('function', 'method')").withColumnRenamed("file_path", "path")
    v = v.join(latest(table(s, d, "symbols"), "id", "indexed_at", ["id", "indexed_at", "params"]).select("id", F.transform("params", lambda x: x["name"]).alias("want")), "id")
    j = v.join(table(s, d, "sources").filter("body <> ''").select("path").distinct(), "path", "left_semi").join(mine, ["path", "name", "start_line"], "left")
    n = lambda c, name: F.count_if(c).alias(name)
    return j.groupBy("language").agg(F.count("*").alias("symbols"), n(F.col("k").isNotNull(), "found"), n(F.col("k") == F.col("kind"), "same_kind"), n(F.col("e") == F.col("end_line"), "same_span"), n(F.col("p") == F.col("want"), "same_params"), n(F.col("r").eqNullSafe(F.col("return_type")) & F.col("k").isNotNull(), "same_return"))


QUERIES = {
    "extract_signatures": lambda s, d: with_signatures(_all(s, d)).select("path", "name", "kind", "start_line", "signature", F.array_join(F.transform("params", lambda x: F.concat_ws(":", x["name"], x["type_annotation"])), ", ").alias("params"), "return_type", F.size("generic_params").alias("generics")),
    "extract_agreement": agreement,
    "extract_symbols": lambda s, d: _all(s, d).filter("what = 'symbol'").drop("what"),
    "extract_references": lambda s, d: _all(s, d).filter("what = 'reference'").select("path", "name", "kind", F.col("start_line").alias("line"), "parent"),
    "extract_imports": lambda s, d: _all(s, d).filter("what = 'import'").select("path", "name", "kind", F.col("start_line").alias("line")),
    "manifest_dependencies": lambda s, d: manifests(_projects(s, d)),
}
ORACLES = {
    "manifest_dependencies": "SELECT concat('p', project_id, '/package.json') AS path, concat('p', project_id) AS project, NULL::VARCHAR AS version, 'npm' AS ecosystem, name AS dependency, coalesce(max(version), '*') AS dependency_version, bool_or(is_dev) AS is_dev FROM dependencies WHERE project_id IS NOT NULL AND name IS NOT NULL GROUP BY project_id, name",
}
