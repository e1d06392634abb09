"""Problem 2: functions paired with the comments that really document them.

Comment spans and function spans of whole source texts are found independently; statements are a third kind of span. An
as-of interval join over (path, line) gives each function the nearest comment before its header, or the nearest string
below it where the language documents inside, and rejects the pair when a statement or another function lies between.
The join is one window over the union of the spans, ordered by position.

A symbol of the index is anchored to the function of its path, line and name. Its own comment is a span of that text:
the pair stands if the join attached this comment to this function. If the text has the comment, but the join attached
another or none (a statement lies between), the pair is rejected. A symbol without a text (a dependency's, a null path), a
span that is off, a text that no longer parses, or a comment that its text doesn't have, can only be judged by its row, in
which the comment stands at its function. Pairs with a blank signature or a trivial comment are dropped.

Scale: texts give few spans (statements in a row are one), and these are partitioned by path, whose size is that of one
text; symbols, of which a path may have any number, are not in the window but join its result by (path, line, name).
Comments are compared by a hash of their letters. No group is gathered; windows sort and spill. Everything about comments
runs as Spark expressions; only the lexing of source texts is Python.

Defined cases: null or blank signatures and comments make no pair; kinds are compared as spelled out; of copies and
states of a symbol the latest counts; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import lang
from codeloom.llm.lexing import FAMILY, lex, real_language
from codeloom.llm.parsing import parsed
from codeloom.sources.tables import clean_path, latest, materialise, table

# What makes a line of a comment trivial, by reason. Java's regex dialect, matched against a whole line.
PLACEHOLDERS = r"(?:(?:todo|fixme|xxx|tbd|tba|hack|wip|pending)\b.*|n/?a|none|null|placeholder\W*|(?:add |insert |missing |your |write )?(?:a )?(?:description|documentation|docs?|doc ?string|comment|summary)(?: (?:goes|comes|to come|to be added|missing|pending|needed))?(?: here)?\W*|to be (?:done|written|documented|determined|added)\W*|(?:automatically|auto)[- ]?generated\b.*|undocumented\W*|not (?:yet )?documented\W*|no (?:description|documentation|comment)\b.*|lorem ipsum\b.*)"
POINTERS = r"(?:(?:see|siehe|voir|véase|ver|vedi|zie|см\.?|ditto|idem|same as|as|like|refer to|cf\.?)(?: (?:also|the|too))?(?: \S+){0,3}|\{@(?:inheritdoc|link|see)[^}]*\}|[@\\](?:see|link|inheritdoc|copydoc)\b.*|(?:inherits?|inherited)(?: \S+){0,3}|同上|参[见照考]\S*|見よ|上記参照|上に同じ)\W*"
TOOLS = r"(?:[@#]?(?:noqa|nosec|nolint|noinspection|eslint|tslint|jslint|jshint|pylint|flake8|mypy|ruff|rustfmt|clippy|prettier|ts-ignore|ts-nocheck|ts-expect-error|clang-format|clang-tidy|istanbul|c8|v8|checkstyle|spotless|spotbugs|suppress\w*|cspell|spell-?checker|shellcheck|biome|ktlint|detekt|luacheck|selene|stylua|pragma|region|endregion|fmt|isort|yapf|black|type|coverage|codecov|sonar|resharper|go:\w+|lint)(?:[-: ].*|:.*)?)"
RIGHTS = r"(?:(?:©|\(c\)|copyright|spdx-|licen[sc]ed under|all rights reserved|portions copyright|license:)\b?.*|©.*)"
CODE = r"(?:.*[;{}]|(?:return|throw|raise|yield|goto|break|continue|import|package|using|#include|local|let|var|val|const|final)\b[^.!?。]*[=+\-*/%()\[\]<>].*|[\w.\[\]>-]+\s*(?:[-+*/%&|^]|<<|>>|:)?=\s*\S.*|[\w.:]+\([^()]*\)(?:\.\w+\([^()]*\))*|(?:else|end|fi|done|pass|do|then)\W*)"
TAGS = r"(?:[@\\:]\w+:?(?:\s*\{[^}]*\})?(?:\s+\S+){0,3}\W*)"
TRIVIAL_LINE = rf"(?iu)^(?:[^\p{{L}}\p{{N}}]*|{PLACEHOLDERS}|{POINTERS}|{TOOLS}|{RIGHTS}|{CODE}|{TAGS})$"
# Words that say nothing beside the words of a name.
FILLERS = "the a an this that these to of for in on by and or function functions method methods func fn procedure routine constructor getter setter class helper does do is are it its will from with at as be which given".split()


def comment_lines(doc: Column) -> Column:
    """The lines of a comment without its markers, XML tags and margins."""
    text = F.regexp_replace(doc, r"\r\n?|[ \u0085]", "\n")
    text = F.regexp_replace(text, r"(?m)^[ \t]*(?:/\*+!?|\*+/|\*+(?!/)|//[/!]?|--\[=*\[|---?(?!-)|#+(?![a-z])!?|\"\"\"|''')[ \t]?", "")
    text = F.regexp_replace(text, r"(?m)[ \t]*(?:\*+/|\]=*\]|\"\"\"|''')[ \t]*$", "")
    return F.transform(F.split(F.regexp_replace(text, r"</?[A-Za-z][^<>]*>", " "), "\n"), lambda x: F.trim(x))


def _stem(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(word), "(?:ies|es|s|ied|ed|ing|ers?|e|y)$", ""), "(.)\\1$", "$1")


def _words(text: Column) -> Column:
    spread = F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    return F.filter(F.split(F.lower(spread), r"[^\p{L}]+"), lambda w: w != "")


def is_trivial(doc: Column, name: Column) -> Column:
    """True where no line of the comment says anything that its symbol's name doesn't. Null and blank are trivial."""
    left = F.filter(comment_lines(doc), lambda x: ~x.rlike(TRIVIAL_LINE))
    said = F.filter(_words(F.array_join(left, " ")), lambda w: ~w.isin(FILLERS))
    news = F.array_except(F.transform(said, _stem), F.transform(_words(F.coalesce(name, F.lit(""))), _stem))
    return F.coalesce(F.size(news) <= 0, F.lit(True))


SPAN = "role string, pos double, end double, name string, kind string, text string"


def attach(spans: DataFrame) -> DataFrame:
    """As-of interval join of `spans` (holder, role, pos, end, name, kind, text).

    Roles: 'function' (text: the signature), 'comment' (documents what comes after it), 'inner' (documents the function
    whose header comes before it), 'statement'. Gives (holder, pos, kind, name, signature, doc, rejected): each function
    with the nearest comment that no statement and no other function parts from it; an inner comment goes before an
    outer. rejected: a comment of its kind was there since the function before, but a statement lies between.
    """
    w = Window.partitionBy("holder").orderBy("pos", "end", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    role = F.col("role")
    before = (
        spans.withColumn("c", F.last(F.when(role == "comment", F.struct("end", "text")), True).over(w))
        .withColumn("f", F.last(F.when(role == "function", F.struct("pos", "end", "kind", "name", "text")), True).over(w))
        .withColumn("t", F.max(F.when(role == "statement", F.col("end"))).over(w))
        .filter(role.isin("function", "inner"))
    )
    none, at = F.lit(None).cast("string"), F.coalesce("c.end", F.lit(-1.0))
    fresh, parted = F.col("c").isNotNull() & (at > F.coalesce("f.end", F.lit(-1.0))), at <= F.coalesce("t", F.lit(-1.0))
    outer = before.filter(role == "function").select("holder", "pos", "kind", "name", F.col("text").alias("signature"), F.when(fresh & ~parted, F.col("c.text")).alias("outer"), none.alias("inner"), (fresh & parted).alias("rejected"))
    below = F.coalesce("t", F.lit(-1.0)) > F.col("f.end")
    inner = before.filter((role == "inner") & F.col("f").isNotNull()).select("holder", F.col("f.pos").alias("pos"), F.col("f.kind").alias("kind"), F.col("f.name").alias("name"), F.col("f.text").alias("signature"), none.alias("outer"), F.when(~below, F.col("text")).alias("inner"), below.alias("rejected"))
    # Of several strings below a header the first counts: the others come after a statement, the first itself.
    each = outer.unionByName(inner).groupBy("holder", "pos").agg(*[F.max(c).alias(c) for c in ("kind", "name", "signature", "outer", "inner", "rejected")])
    doc = F.coalesce("inner", "outer")
    return each.select("holder", "pos", "kind", "name", "signature", doc.alias("doc"), (F.col("rejected") & doc.isNull()).alias("rejected"))


def documented(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.coalesce(F.trim("signature"), F.lit("")).rlike(r"\S") & F.col("doc").isNotNull() & ~is_trivial(F.col("doc"), F.col("name")))


def letters(doc: Column) -> Column:
    """A hash of a comment's letters and digits, without its markers and XML tags."""
    return F.xxhash64(F.regexp_replace(F.lower(F.array_join(comment_lines(doc), " ")), r"[^\p{L}\p{N}]+", ""))


def _documented_symbols(symbols: DataFrame) -> DataFrame:
    v = latest(symbols, "id", "indexed_at", ["id", "indexed_at", "kind", "name", "signature", "doc_comment", "file_path", "start_line"])
    v = v.withColumn("kind", lang.kind(F.col("kind"))).filter(F.col("kind").isin("function", "method") & F.col("signature").rlike(r"\S") & F.col("doc_comment").rlike(r"\S"))
    return documented(v.select(F.col("id").alias("holder"), "kind", "name", "signature", F.col("doc_comment").alias("doc"), clean_path(F.col("file_path")).alias("path"), "start_line"))


def paired_symbols(symbols: DataFrame, sources: DataFrame, files: DataFrame) -> DataFrame:
    """(holder) the ids of the valid symbols whose pair stands."""
    spans = materialise(source_spans(sources, file_languages(files)).withColumn("text", F.when(F.col("role") != "function", F.hex(letters(F.col("text"))))))
    joined = attach(spans).select(F.col("holder").alias("path"), F.col("pos").cast("int").alias("start_line"), "name", F.coalesce("doc", F.lit("")).alias("attached"))
    # A symbol without a path has no anchor; its id spreads it.
    own = _documented_symbols(symbols).select("holder", F.coalesce("path", F.concat(F.lit("\0"), "holder")).alias("path"), "start_line", "name", F.hex(letters(F.col("doc"))).alias("own"))
    anchored = own.join(joined.groupBy("path", "start_line", "name").agg(F.max("attached").alias("attached")), ["path", "start_line", "name"], "left")
    sure = F.col("attached").isNull() | (F.col("attached") == F.col("own"))
    anchored = materialise(anchored.select("holder", F.when(~sure, F.col("path")).alias("path"), F.when(~sure, F.col("own")).alias("own"), sure.alias("sure")))
    there = spans.filter(F.col("role").isin("comment", "inner")).select(F.col("holder").alias("path"), F.col("text").alias("own")).distinct()
    parted = anchored.filter("not sure").join(there, ["path", "own"], "left_semi")
    # Few are left: those whose comment is elsewhere in their text. Where that doesn't parse, its spans place nothing.
    texts = sources.join(parted.select("path").distinct(), "path", "left_semi")
    whole = parsed(texts, files).groupBy("path").agg(F.max("error").alias("error")).filter("error is null")
    return anchored.select("holder").join(parted.join(whole, "path", "left_semi").select("holder"), "holder", "left_anti")


def symbol_pairs(symbols: DataFrame, sources: DataFrame, files: DataFrame) -> DataFrame:
    """(holder, kind, name, signature, doc) of these; holder is the symbol's id."""
    return _documented_symbols(symbols).join(paired_symbols(symbols, sources, files), "holder", "left_semi").select("holder", "kind", "name", "signature", "doc")


# Headers of functions, by language. Group "name" is the name.
HEADERS = {
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(?P<name>\w+)[^{;]*",
    "python": r"^[ \t]*(?:async\s+)?def\s+(?P<name>\w+)\s*\((?:[^()]|\([^()]*\))*\)[^:]*",
    "typescript": r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:(?:async\s+)?function\s*\*?\s*(?P<name>\w+)\s*(?:<[^>]*>)?\([^)]*\)[^{;]*|(?:(?:public|private|protected|static|readonly|override|async|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(?P<name2>\w+)\s*(?:<[^>]*>)?\([^)]*\)\s*(?::[^{;=]+)?(?=\s*\{))",
    "java": r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)+(?:<[^>]*>\s*)?(?:[\w.<>\[\],? ]+\s+)?(?P<name>\w+)\s*\([^)]*\)[^{;=]*",
    "kotlin": r"^[ \t]*(?:(?:public|private|protected|internal|open|override|suspend|inline|operator|abstract|final|tailrec|infix)\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?(?P<name>\w+)\s*\([^)]*\)[^{=\n]*",
    "go": r"^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\([^)]*\)[^{\n]*",
    "cpp": r"^[ \t]*(?!return\b|else\b|if\b|for\b|while\b|switch\b|using\b|namespace\b|class\b|struct\b)(?:[\w:<>,&*~]+[ \t]+)+[&*]*(?P<name>[\w:~]+)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)[^;{}=]*(?=\{)",
    "csharp": r"^[ \t]*(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|async|extern|partial|unsafe|new)\s+)+(?:[\w.<>\[\],?]+\s+)?(?P<name>\w+)\s*(?:<[^>]*>)?\([^)]*\)[^{;=]*",
    "lua": r"^[ \t]*(?:local\s+)?function\s+(?P<name>[\w.:]+)\s*\([^)]*\)",
}
ANNOTATION = re.compile(r"^\s*(?:@[\w.]+|#!?\[|\[[A-Z]\w*.*\]\s*$|template\s*<)")
_COMPILED = {k: re.compile(v, re.M) for k, v in HEADERS.items()}


def file_spans(body: str, language: str | None) -> list[tuple]:
    """All spans of a text: (role, pos, end, name, kind, text) with lines as positions."""
    body = re.sub(r"\r\n?", "\n", body.lstrip("﻿"))
    language = real_language(body, language)
    if language not in _COMPILED:
        return []
    found, plain, last = [], [], 0
    pieces = lex(body, FAMILY[language])
    line_starts = [0, *(m.end() for m in re.finditer("\n", body))]
    line = lambda at: bisect_right(line_starts, at)
    inner = []
    for kind, start, end, text in pieces:
        if kind == "string":
            continue
        plain += [body[last:start], re.sub(r"[^\n]", " ", text)]
        last = end
        if kind == "comment":
            found.append([line(start), line(max(start, end - 1)), text, start])
        else:
            inner.append(("inner", float(line(start)), float(line(max(start, end - 1))), None, None, text))
    code = "".join([*plain, body[last:]])
    merged: list[list] = []
    for a, b, text, at in sorted(found):
        own_line = code[line_starts[a - 1] : at].strip() == ""
        if not own_line:
            continue  # a remark behind code documents nothing below
        if merged and merged[-1][1] == a - 1 and merged[-1][2][:2] == text[:2] and text[:2] != "/*":
            merged[-1][1:3] = [b, merged[-1][2] + "\n" + text]
        else:
            merged.append([a, b, text])
    spans: list[tuple] = [("comment", float(a), float(b), None, None, t) for a, b, t in merged] + inner
    covered = set()
    for m in _COMPILED[language].finditer(code):
        name = m["name"] or (m.groupdict().get("name2") or "")
        a, b = line(m.start() + len(m[0]) - len(m[0].lstrip())), line(max(m.start(), m.end() - 1))
        signature = re.sub(r"\s+", " ", m[0]).strip()
        method = m[0][:1] in " \t" or (language == "go" and re.match(r"func\s*\(", m[0])) or "." in name or ":" in name
        spans.append(("function", float(a), float(b), re.split(r"[.:]+", name)[-1], "method" if method else "function", signature))
        covered.update(range(a, b + 1))
    # Statements in a row are one span; it ends where a comment or a header begins.
    breaks = covered | {int(x[1]) for x in spans}
    block: list[int] = []
    for i, text in enumerate(code.split("\n"), 1):
        if i in breaks and block:
            spans.append(("statement", float(block[0]), float(block[1]), None, None, None))
            block = []
        if i not in covered and text.strip() not in ("", "{", "}") and not ANNOTATION.match(text):
            block = [block[0] if block else i, i]
    if block:
        spans.append(("statement", float(block[0]), float(block[1]), None, None, None))
    return spans


def source_spans(sources: DataFrame, languages: DataFrame) -> DataFrame:
    """(holder, role, pos, end, name, kind, text) of every source text; `languages` is (path, language)."""
    d = sources.filter("path is not null and body is not null").select("path", "body").distinct().join(languages, "path", "left").withColumn("language", lang.language(F.col("language"), F.col("path")))
    names = ["holder", "role", "pos", "end", "name", "kind", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *s) for p, body, lg in zip(b.column("path").to_pylist(), b.column("body").to_pylist(), b.column("language").to_pylist(), strict=True) for s in file_spans(body, lg)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    return d.select("path", "body", "language").mapInArrow(run, "holder string, " + SPAN)


def file_languages(files: DataFrame) -> DataFrame:
    """(path, language): the latest non-blank language of each path, as spelled."""
    return latest(files.filter(F.trim("language") != ""), "path", "indexed_at", ["path", "indexed_at", "language"]).select("path", "language")


def _pairs(spark, sf_dir: str) -> DataFrame:
    return symbol_pairs(*[table(spark, sf_dir, n) for n in ("symbols", "sources", "files")])


def p2_found(spark, sf_dir: str) -> DataFrame:
    return paired_symbols(*[table(spark, sf_dir, n) for n in ("symbols", "sources", "files")]).select(F.col("holder").alias("symbol_id"))


def description(doc: Column) -> Column:
    """The lines of a comment that say something, without markers."""
    return F.trim(F.array_join(F.filter(comment_lines(doc), lambda x: ~x.rlike(TRIVIAL_LINE)), "\n"))


def p2_pairs(spark, sf_dir: str) -> DataFrame:
    """symbol_id, kind, signature and description."""
    return _pairs(spark, sf_dir).select(F.col("holder").alias("symbol_id"), "kind", F.trim("signature").alias("signature"), description(F.col("doc")).alias("description"))


def _spans(spark, sf_dir: str) -> DataFrame:
    return source_spans(table(spark, sf_dir, "sources"), file_languages(table(spark, sf_dir, "files")))


def p2_source_pairs(spark, sf_dir: str) -> DataFrame:
    """The same from whole source texts: path, line, kind, name, signature, description."""
    p = documented(attach(_spans(spark, sf_dir)))
    return p.select(F.col("holder").alias("path"), F.col("pos").cast("int").alias("line"), "kind", "name", "signature", description(F.col("doc")).alias("description"))


def p2_rejected(spark, sf_dir: str) -> DataFrame:
    """(path, line, name) of the functions whose comment the join rejected, as a statement lies between."""
    return attach(_spans(spark, sf_dir)).filter("rejected").select(F.col("holder").alias("path"), F.col("pos").cast("int").alias("line"), "name")


QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs, "p2_source_pairs": p2_source_pairs, "p2_rejected": p2_rejected}
ORACLES: dict[str, str] = {}
