"""Problem 5: source files that their language's grammar rejects.

Each language has a bundled grammar of productions and lexemes (`grammar`). Tables are built from them, and one
generalised LR driver runs the whole token stream over these (`glr`); nothing in the code here knows a language. A text's
first token that no parse can go on with, or its end while all parses are open, is the error that is reported; there is
no recovery. Lexemes that begin nothing (typographic quotes, noise, open strings and comments, conflict marks) and
indentation of no open block are errors as well.

How line ends count is a grammar's `layout`: as indentation; as a semicolon behind certain tokens; as a separator behind
certain tokens unless others follow; or only where the next token would be an error. Words that are keywords in places
are offered to the tables both ways. Where a grammar has markup, a text is valid with it or without it; its open elements
are kept on the scanner's stack, which also requires that closing names match.

Scale: one narrow Python pass over distinct (path, body); the language comes by a join with the latest row of each
path. Rates are aggregations. Texts are parsed whole, in time linear in their length where the grammar's forks are local.

Defined cases: null, empty and blank bodies and texts in languages without a grammar aren't judged; a byte-order mark
and any line ends are fine; a text of comments only is valid; copies of a row give one path; a path with several bodies is found if one is invalid.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import lang
from codeloom.llm.glr import Parser, Tables
from codeloom.llm.grammar import SPECS, Spec
from codeloom.sources.tables import latest, table

CLOSES = {")": "(", "]": "[", "}": "{"}
BLANK = r"[ \t\f\v\r\x1a\xa0\ufeff]*"
MARK = r"(?P<mark>(?:(?<=\n)|(?<=\A))(?:<{7}|>{7}|={7}|\|{7})(?=\s|\Z))|"
_NAME = r"(?:[^\W\d]|\$)[\w$-]*"
TAG = re.compile(rf"<\s*(?P<name>(?:{_NAME}(?:[.:]{_NAME})*)?)")
TAG_PART = re.compile(rf"(?P<blank>(?:\s|//[^\n]*|/\*.*?\*/)+)|(?P<SELFCLOSE>/\s*>)|(?P<TAGEND>>)|(?P<open>\{{)|(?P<TAG><)|(?P<sign>=)|(?P<STR>\"[^\"]*\"|'[^']*')|(?P<ATTR>{_NAME}(?::{_NAME})?)", re.S)
CHILD_PART = re.compile(rf"(?P<blank>(?:\s|(?<=\}})\s)+)|(?P<CLOSE></\s*(?P<name>(?:{_NAME}(?:[.:]{_NAME})*)?)\s*>)|(?P<open>\{{)|(?P<TAG><)|(?P<TEXT>[^<>{{}}]+)", re.S)


class Rejected(Exception):
    def __init__(self, at: int, why: str):
        self.at, self.why = at, why


class Language:
    """A grammar's tables and its scanner."""

    def __init__(self, spec: Spec):
        literals = set(re.findall(r"'([^']+)'", spec.rules))
        classes: dict[str, list[str]] = {}
        for name, signs in spec.classes.items():
            for s in signs.split():
                classes.setdefault(s, []).append(name)
        soft = frozenset(spec.soft.split())
        words = frozenset(x for x in literals if re.fullmatch(r"\w+", x))
        self.terms: dict[str, tuple] = {x: (*(["ID"] if x in soft else []), *(["'" + x] if x in literals else []), *classes.get(x, [])) for x in literals | set(classes) | soft}
        signs = sorted((x for x in literals | set(classes) if not re.fullmatch(r"\w+", x)), key=len, reverse=True)
        self.extra = frozenset(g for g in re.findall(r"\(\?P<([A-Z]+)>", spec.lexemes))
        self.tables = Tables(spec.rules, "file", words - soft, self.extra | set(spec.classes) | set(spec.shapes) | {"ID"})
        self.parser = Parser(self.tables)
        self.pattern = re.compile(BLANK + rf"(?:(?P<nl>\n[ \t\n]*)|(?P<ID>{spec.name})(?![\w$\"'#@`])|" + MARK + spec.lexemes + rf"|(?P<word>{spec.name})|(?P<sign>{'|'.join(re.escape(x) for x in signs)})|(?P<junk>.))", re.S)
        name = lambda x: x if x.isupper() and len(x) > 1 else "'" + x
        self.ends, self.value = (frozenset(map(name, x.split())) for x in (spec.ends, spec.value))
        self.joins = frozenset(t for x in spec.joins.split() for t in self.terms.get(x, (x,)) if t != "ID")
        self.literal = re.compile(spec.pattern) if spec.pattern else None
        self.shape = re.compile("|".join(f"(?P<{k}>{v})" for k, v in spec.shapes.items())) if spec.shapes else None
        self.layout, self.markup = spec.layout, spec.markup

    def scan(self, text: str, markup: bool = False) -> Iterator[tuple]:
        """(terminals, position, whether a line ended before) of each token."""
        match, terms, shape, n, i = self.pattern.match, self.terms, self.shape, len(text), 0
        before: tuple = ()
        newline, fixed = False, {g: (g,) for g in self.extra | {"ID"}}
        modes: list[list] = []  # open elements of markup and braces within them
        while i < n:
            if modes and modes[-1][0] != "brace":
                i, token = self._markup(text, i, modes)
                if token is not None:
                    yield token[0], token[1], False
                    before = token[0]
                continue
            m = match(text, i)
            kind, i = m.lastgroup, m.end()
            if kind == "nl":
                newline = True
                continue
            at = m.start(kind)
            if kind == "ID" or kind == "word":
                s = m[kind]
                t = terms.get(s) or (fixed["ID"] if shape is None or (shaped := shape.fullmatch(s)) is None else ("ID", shaped.lastgroup))
            elif kind == "skip" or kind == "pp" or kind == "join":
                newline = newline or (kind == "skip" and "\n" in m[kind]) or kind == "pp"
                continue
            elif kind == "sign":
                s = m[kind]
                t = terms[s]
                if self.literal is not None and s[0] == "/" and not self.value.intersection(before):
                    if (r := self.literal.match(text, at)) is not None:
                        i, t = r.end(), ("REGEX",)
                elif markup:
                    if s == "<" and not self.value.intersection(before):
                        e = self._tag(text, at)
                        if e is not None:
                            modes.append(["tag", e[0], at])
                            i, t = e[1], ("TAG",)
                    elif modes and s in "{}":
                        modes[-1][1] += 1 if s == "{" else -1
                        if not modes[-1][1]:
                            modes.pop()
            elif kind == "mark":
                raise Rejected(at, "a conflict mark")
            elif kind == "junk" and not text[at:].strip():
                break
            elif kind in ("bad", "junk"):
                raise Rejected(at, "no token begins with " + repr(m[kind][:12]))
            else:
                t = fixed[kind]
            yield t, at, newline
            before, newline = t, False
        if modes:
            raise Rejected(n, f"<{modes[0][1]}> is never closed" if modes[0][0] != "brace" else "'{' is never closed")

    @staticmethod
    def _tag(text: str, at: int) -> tuple[str, int] | None:
        """(name, end) of a tag that opens here, its type arguments included; None where a type parameter does."""
        m = TAG.match(text, at)
        name, i = m["name"], m.end()
        if not name:
            return ("", i) if re.compile(r"\s*>").match(text, i) else None
        if re.compile(r"\s*(?:,|=(?!>)|extends\s)").match(text, i) or (name[0].isupper() and text.startswith(">(", i) and f"</{name}" not in text[i:]):
            return None
        if text.startswith("<", i):
            depth = 0
            while i < len(text):
                depth += (text[i] == "<") - (text[i] == ">" and text[i - 1] != "=")
                i += 1
                if not depth:
                    break
        return name, i

    def _markup(self, text: str, i: int, modes: list) -> tuple[int, tuple | None]:
        top = modes[-1]
        m = (TAG_PART if top[0] == "tag" else CHILD_PART).match(text, i)
        if m is None:
            raise Rejected(i, f"no part of <{top[1]}> begins with {text[i : i + 12]!r}")
        kind = m.lastgroup if m.lastgroup != "name" else "CLOSE"
        if kind == "blank":
            return m.end(), None
        if kind == "TAGEND":
            top[0] = "element"
        elif kind == "SELFCLOSE" or kind == "CLOSE":
            if kind == "CLOSE" and m["name"] != top[1]:
                raise Rejected(i, f"</{m['name']}> closes nothing, <{top[1]}> is open")
            modes.pop()
        elif kind == "TAG":
            e = self._tag(text, i)
            if e is None:
                raise Rejected(i, "no element begins here")
            modes.append(["tag", e[0], i])
            return e[1], (("TAG",), i)
        elif kind == "open":
            modes.append(["brace", 1, i])
            return m.end(), (self.terms["{"], i)
        elif kind == "sign":
            return m.end(), (self.terms["="], i)
        return m.end(), ((kind,), i)

    def laid_out(self, text: str, markup: bool) -> Iterator[tuple]:
        """The tokens with those that stand for line ends."""
        tokens = self.scan(text, markup)
        if self.layout == "indent":
            yield from self._indented(text, tokens)
        elif self.layout in ("semicolon", "line"):
            line, before, closed = self.layout == "line", (), []
            extra = ("NL",) if line else ("';",)
            for t, at, newline in tokens:
                if newline and self.ends.intersection(before) and not (line and (closed and closed[-1] != "'{" or self.joins.intersection(t))):
                    yield extra, at, False
                if line:
                    if t[0] in ("'(", "'[", "'{"):
                        closed.append(t[0])
                    elif t[0] in ("')", "']", "'}") and closed:
                        closed.pop()
                yield t, at, newline
                before = t
            if not line and self.ends.intersection(before):
                yield extra, len(text), False
        else:
            yield from tokens

    @staticmethod
    def _indented(text: str, tokens: Iterator[tuple]) -> Iterator[tuple]:
        columns, depth, any_ = [0], 0, False
        for t, at, newline in tokens:
            if (newline or not any_) and not depth:
                if any_:
                    yield ("NEWLINE",), at, False
                start = text.rfind("\n", 0, at) + 1
                column = 0
                for c in text[start:at]:
                    column = (column // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else column + 1
                if column > columns[-1]:
                    columns.append(column)
                    yield ("INDENT",), at, False
                else:
                    while column < columns[-1]:
                        columns.pop()
                        yield ("DEDENT",), at, False
                    if column != columns[-1]:
                        raise Rejected(at, "indentation of no open block")
            any_ = True
            if t[0] in ("'(", "'[", "'{"):
                depth += 1
            elif t[0] in ("')", "']", "'}"):
                depth = max(0, depth - 1)
            yield t, at, newline
        if any_:
            yield ("NEWLINE",), len(text), False
        for _ in columns[1:]:
            yield ("DEDENT",), len(text), False

    def run(self, text: str, markup: bool = False) -> None:
        tokens = self.laid_out(text, markup)
        if self.layout == "offence":
            bad = self.parser.run(tokens, ("';",), lambda token: token[2] or token[0][0] == "'}")
        else:
            bad = self.parser.run(tokens)
        if bad is None:
            return
        t, at = bad[:2] if bad else ((), len(text))
        shown = text[at:].split(None, 1)
        if not shown:
            raise Rejected(len(text), "unexpected end of the text")
        raise Rejected(at, "unexpected " + {"NEWLINE": "end of the line", "NL": "end of the line", "INDENT": "indentation", "DEDENT": "end of a block"}.get(t[0], shown[0][:40]))


@functools.cache
def grammar_of(language: str) -> Language:
    return Language(SPECS[language])


def parse(body: str, language: str) -> tuple[int, str] | None:
    """(line, reason) of the first error, or None for a valid text."""
    text = body.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if not text.strip():
        return None
    g = grammar_of(language)
    try:
        g.run(text)
    except Rejected as e:
        error = e
        if g.markup and re.search(r"</|/\s*>", text):
            try:
                g.run(text, True)
                return None
            except Rejected as with_markup:
                error = with_markup if with_markup.at > e.at else e
        return text.count("\n", 0, min(error.at, len(text))) + 1, error.why
    return None


def parsed(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(path, language, project_id, line, error) of each distinct path and non-blank body; line and error are null for
    a valid text. Bodies in languages without a grammar are left out."""
    facts = latest(files.withColumn("language", F.nullif(F.trim("language"), F.lit(""))), "path", "indexed_at", ["path", "indexed_at", "language", "project_id"]).select("path", "language", "project_id")
    named = latest(files.filter(F.trim("language") != ""), "path", "indexed_at", ["path", "indexed_at", "language"]).select("path", F.col("language").alias("named"))
    d = (
        sources.filter(F.col("path").isNotNull() & F.col("body").rlike(r"[^\s\x{FEFF}]"))
        .select("path", "body")
        .distinct()
        .join(facts, "path", "left")
        .join(named, "path", "left")
        .select("path", "body", lang.language(F.coalesce("language", "named"), F.col("path")).alias("language"), F.col("project_id").cast("long").alias("project_id"))
        .filter(F.col("language").isin(list(SPECS)))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = [parse(t, lg) for t, lg in zip(b.column("body").to_pylist(), b.column("language").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("language"), b.column("project_id"), pa.array([x and x[0] for x in r], pa.int32()), pa.array([x and x[1] for x in r], pa.string())], names=["path", "language", "project_id", "line", "error"])

    return d.mapInArrow(run, "path string, language string, project_id long, line int, error string")


def p5_found(spark, sf_dir: str) -> DataFrame:
    return parsed(table(spark, sf_dir, "sources"), table(spark, sf_dir, "files")).filter("error is not null").select("path").distinct()


def p5_errors(spark, sf_dir: str) -> DataFrame:
    """The first unrecoverable error of each invalid file."""
    return parsed(table(spark, sf_dir, "sources"), table(spark, sf_dir, "files")).filter("error is not null")


def p5_rates(spark, sf_dir: str) -> DataFrame:
    """Files and invalid files per repository (null: unknown) and language."""
    p = parsed(table(spark, sf_dir, "sources"), table(spark, sf_dir, "files")).groupBy("path", "language", "project_id").agg(F.max(F.col("error").isNotNull().cast("int")).alias("bad"))
    return p.groupBy("project_id", "language").agg(F.count("*").alias("files"), F.sum("bad").alias("invalid")).withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))


QUERIES = {"p5_found": p5_found, "p5_errors": p5_errors, "p5_rates": p5_rates}
ORACLES: dict[str, str] = {}
