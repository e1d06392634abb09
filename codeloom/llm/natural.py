"""Problem 6: natural language in comments and strings of source files, and in the doc comments of symbols.

Comments and strings are cut out by the regular expressions of the language's delimiter family (`lexing`); a text that
is really in another language than its path says uses that one's. Adjacent comment lines are merged, then split into
sentences. A sentence counts from four words in a row (eight signs where words aren't spaced) and is classified by the
distance of its n-grams to the ranked n-gram profiles of the languages; a sentence too far from every profile (names,
keys, code), as near to two, or nearest to another language, is rejected.

Distance: the mean, over the n-grams (1 to 4 signs, words padded; 1 and 2 where words aren't spaced) of a sentence, of the
rank in the language's profile, `PROFILE` for those outside of it. In a sentence nearly all n-grams occur once, so their
own ranks tie and are taken as zero. A sentence is compared with the profiles of its script: those of the ten languages,
and those of other languages, which aren't reported: a sentence nearest to one of these is rejected as well. All sentences
of a batch are measured at once (numpy). Profiles are trained at first use from `language_samples`.

Scale: narrow Python passes over sources and over the valid symbols' comments, without a shuffle but the one that finds
valid rows and languages. Sentences are remembered by their words (numbers aside) up to a bound; that changes speed only.

Defined cases: null and empty bodies and comments hold none; a symbol has its largest language only, ties go to the
first code; repeated rows give one row; shares are of the file's characters.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import lang
from codeloom.llm.docpairs import file_languages
from codeloom.llm.language_samples import RIVALS, SAMPLES
from codeloom.llm.lexing import FAMILY, lex, real_language
from codeloom.sources.tables import latest, table

PROFILE, REJECT, MARGIN, REMEMBER = 1500, 0.72, 0.012, 200_000
# The languages of each script, those that are reported first, and the n-grams that are counted.
SCRIPTS = {"latin": ["en", "de", "fr", "es", "pt", "it", "nl", "sv", "da", "no", "pl", "cs", "hr", "ro", "ca", "tr", "fi", "hu"], "cyrillic": ["ru", "uk", "bg", "sr"], "unspaced": ["ja", "zh"]}
NGRAMS = {"latin": (1, 2, 3, 4), "cyrillic": (1, 2, 3, 4), "unspaced": (1, 2)}
REJECTS = {"latin": REJECT, "cyrillic": REJECT, "unspaced": 0.97}
MARKER = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*+(?!/)|//[/!]*|--\[=*\[|-{2,3}(?!-)|#+!?|\"\"\"|''')?[ \t]?|[ \t]*(?:\*+/|\]=*\]|\"\"\"|''')[ \t]*$", re.M)
TAG_LINE = re.compile(r"^\s*(?:[@\\]\w+\b|:\w+[^:]*:)(?:\s*\{[^}]*\})?(?:\s+\w+$)?", re.M)
NOISE = re.compile(r"`[^`\n]*`|</?[A-Za-z][^<>]*>|\{@[^}]*\}|(?:https?://|www\.)\S+|\b[\w$]*(?:[_$/\\=<>{}\[\]()|#@+*%]|\.(?=\w)|::|(?<=[a-z])(?=[A-Z]))[\w$./\\:()-]*|\b\w*\d\w*[A-Za-z]\w*\b")
MAY_BE_NOISE = re.compile(r"[`<>{}_$\\/=\[\]|#@+*%]|\w\.\w|[a-z][A-Z]|::|\w\(|\d[A-Za-z]|[A-Za-z]\d|www")
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+|(?<=[。！？])")
WORD_RUN = re.compile(r"(?:[^\W\d_]+(?:['’][^\W\d_]+|-[^\W\d_]+)*)(?:[ \t]*[,;:–—(\")]?[ \t]+(?:\d[\d.,]*[ \t]+)*[(\"]?(?:[^\W\d_]+(?:['’][^\W\d_]+|-[^\W\d_]+)*)){3,}")
UNSPACED = re.compile(r"[぀-ヿ㐀-鿿々ー、，0-9]{8,}")
KANA, HAN = re.compile(r"[぀-ヿ]"), re.compile(r"[㐀-鿿々ー぀-ヿ]")
TOOL = re.compile(r"^\s*(?:noqa|nosec|nolint|noinspection|eslint|tslint|pylint|flake8|mypy|type:|prettier|ts-(?:ignore|nocheck|expect)|clang-format|rustfmt|istanbul|c8 |checkstyle|#?region|#?endregion|pragma|fmt:|isort|ktlint|detekt|luacheck|shellcheck|cspell|@generated\b$|coding[:=]|vim:|-\*-)", re.I)
CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?:return|if|for|while|let|var|val|const|local|import|use|using|package|def|fn|func|fun)\b.*[=(+\-*/<>{};:]|^\s*[\w.]+\s*[-+*/]?=\s|^\s*[\w.:]+\(.*\)\s*$")


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """All n-grams of the padded text as 64-bit numbers, tagged by n."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        out = out << np.uint64(16) | codes[i : len(codes) - n + 1 + i]
    return out


def _codes(text: str) -> np.ndarray:
    words = " " + " ".join(re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", text.lower().replace("’", "'"))) + " "
    return np.minimum(np.frombuffer(words.encode("utf-32-le"), np.uint32), 0xFFFF).astype(np.uint64)


@functools.lru_cache(maxsize=4)
def profiles(script: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(sorted n-grams, their rank in each language's profile, languages) of the languages of a script."""
    names = SCRIPTS[script]
    ranks: dict[int, list[int]] = {}
    for j, name in enumerate(names):
        codes = _codes(SAMPLES.get(name) or RIVALS[name])
        count: Counter[int] = Counter()
        for n in NGRAMS[script]:
            g = _grams(codes, n)
            count.update(dict(zip(*[x.tolist() for x in np.unique(g, return_counts=True)], strict=True)))
        for r, (gram, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]):
            ranks.setdefault(gram, [PROFILE] * len(names))[j] = r
    keys = np.array(sorted(ranks), dtype=np.uint64)
    return keys, np.array([ranks[int(k)] for k in keys], dtype=np.float32), names


@functools.lru_cache(maxsize=64)
def common_words(name: str) -> frozenset[str]:
    """Words that a sentence of the language, however short, has at least one of: those its sample repeats."""
    n = Counter(re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", (SAMPLES.get(name) or RIVALS[name]).lower()))
    return frozenset(w for w, k in n.items() if k >= 2)


def distances(sentences: list[str], script: str) -> np.ndarray:
    """Mean out-of-place distance, from 0 to 1, of each sentence to each profile of its script."""
    keys, ranks, names = profiles(script)
    total = np.zeros((len(sentences), len(names)), np.float64)
    count = np.zeros(len(sentences))
    parts = [_codes(s) for s in sentences]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    for n in NGRAMS[script]:
        g = _grams(flat, n)
        who = owner[: len(g)]
        inside = who == owner[n - 1 : n - 1 + len(g)]
        g, who = g[inside], who[inside]
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        r = np.where((keys[at] == g)[:, None], ranks[at], PROFILE)
        for j in range(len(names)):
            total[:, j] += np.bincount(who, r[:, j], len(parts))
        count += np.bincount(who, minlength=len(parts))
    return total / np.maximum(count, 1)[:, None] / PROFILE


class Classifier:
    def __init__(self) -> None:
        self.known: dict[str, str | None] = {}

    def __call__(self, runs: list[str]) -> list[str | None]:
        """The language of each run of words; None if it is rejected."""
        keys = [re.sub(r"\d+", "0", r) for r in runs]
        if len(self.known) > REMEMBER:
            self.known.clear()
        new = list(dict.fromkeys(k for k in keys if k not in self.known))
        parts: dict[str, list[str]] = {}
        for k in new:
            cyrillic = len(re.findall(r"[Ѐ-ӿ]", k))
            parts.setdefault("unspaced" if HAN.search(k) else "cyrillic" if cyrillic * 2 > len(re.findall(r"[^\W\d_]", k)) else "latin", []).append(k)
        for script, all_ in parts.items():
            names = profiles(script)[2]
            for part in (all_[i : i + 2000] for i in range(0, len(all_), 2000)):
                d = distances(part, script)
                order = np.argsort(d, axis=1, kind="stable")
                for i, k in enumerate(part):
                    first, second, name = d[i, order[i, 0]], d[i, order[i, 1]], names[order[i, 0]]
                    words = k.lower().replace("’", "'").split()
                    common = script == "unspaced" or len(words) >= 6 or not common_words(name).isdisjoint(w.strip(",;:()") for w in words)
                    self.known[k] = name if name in SAMPLES and first <= REJECTS[script] and second - first >= MARGIN and common else None
        return [self.known[k] for k in keys]


def runs_of(text: str, comment: bool) -> list[str]:
    """The runs of words, or of unspaced signs, that are long enough to be language."""
    if comment:
        lines = []
        for line in MARKER.sub("", text).split("\n"):
            line = re.sub(r"^[+-](?=\s)", "", line)
            line = re.sub(r"^\s*\*(?!/)\s?", "", line).strip()
            if not line or TOOL.match(line) or CODE_LINE.search(line):
                lines.append("\n")
                continue
            line = TAG_LINE.sub("\n", line)
            # A sentence goes on in the next line only if this one is full.
            lines.append(line + (" " if line[-1:] not in ".!?:。！？" and (len(line) >= 32 or line.count(" ") >= 4) else "\n"))
        text = "".join(lines)
    elif "\n" in text:
        text = "\n".join(x for x in text.split("\n") if not CODE_LINE.search(x))
    elif CODE_LINE.search(text):
        return []
    if text.count(" ") < 3 and text.isascii():
        return []
    out = []
    if MAY_BE_NOISE.search(text):
        text = NOISE.sub(" \x01 ", text)
    for s in SENTENCE.split(text):
        if not s:
            continue
        if HAN.search(s):
            for m in UNSPACED.finditer(s):
                if len(HAN.findall(m[0])) >= 8:
                    out.append(m[0])
            continue
        for m in WORD_RUN.finditer(s):
            out.append(m[0])
    return out


def merged(pieces: list[tuple[str, int, int, str]], body: str) -> list[tuple[bool, str]]:
    """(is a comment, text): line comments on adjacent lines become one."""
    out: list[list] = []
    end = -1
    for kind, a, b, text in pieces:
        comment = kind != "string"
        if comment and out and out[-1][0] and text[:2] == out[-1][1][:2] and not text.startswith("/*") and body[end:a].strip() == "" and body.count("\n", end, a) == 1:
            out[-1][1] += "\n" + text
        else:
            out.append([comment, text if comment else text.strip("\"'`")])
        end = b
    return [(c, t) for c, t in out]


def texts_of(body: str, language: str | None) -> list[tuple[bool, str]]:
    body = re.sub(r"\r\n?", "\n", body.lstrip("﻿"))
    if body.startswith("--- ") and "\n@@ " in body:  # a patch: the lines of the file are behind its signs
        body = "\n".join(x[1:] for x in body.split("\n") if x[:1] in " +-" and not x.startswith(("--- ", "+++ ")))
        head = re.match(r"(?:\s*\*(?!/)[^\n]*\n)+", body)
        body = "/*" + body if head else body
    language = real_language(body, language)
    return merged(lex(body, FAMILY[language]), body) if language in FAMILY else []


def _tally(items: list[list[tuple[bool, str]]], classify: Classifier) -> list[dict[str, int]]:
    """Characters of each language in each item."""
    runs = [[r for c, t in item for r in runs_of(t, c)] for item in items]
    named = iter(classify([r for rs in runs for r in rs]))
    out = []
    for rs in runs:
        n: dict[str, int] = defaultdict(int)
        for r in rs:
            if (name := next(named)) is not None:
                n[name] += len(r)
        out.append(n)
    return out


def _rows(df: DataFrame, key: str, text: str, extract, remember: bool = False) -> DataFrame:
    """(key, nl_lang, chars, share) from (key, text, language)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify, seen = Classifier(), {}
        for b in batches:
            ids, texts, names = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            # Texts that differ in numbers only have the same languages; a number counts as one sign in all of them.
            keys = [re.sub(r"\d+", "0", t) if remember else None for t in texts]
            texts = [t if k is None else k for t, k in zip(texts, keys, strict=True)]
            if len(seen) > REMEMBER:
                seen.clear()
            new = [i for i, k in enumerate(keys) if k is None or k not in seen]
            fresh = dict(zip(new, _tally([extract(texts[i], names[i]) for i in new], classify), strict=True))
            seen.update((keys[i], fresh[i]) for i in new if keys[i] is not None)
            found = [fresh[i] if k is None else seen[k] for i, k in enumerate(keys)]
            rows = [(k, name, n, n / max(1, len(t))) for k, t, f in zip(ids, texts, found, strict=True) for name, n in f.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.string(), pa.string(), pa.int64(), pa.float64()], strict=True)], names=["key", "nl_lang", "chars", "share"])

    return df.select(key, text, "language").mapInArrow(run, "key string, nl_lang string, chars long, share double")


def in_files(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(path, nl_lang, chars, share) of each language in the comments and strings of a file."""
    d = sources.filter(F.col("path").isNotNull() & (F.length("body") > 0)).select("path", "body").distinct().join(file_languages(files), "path", "left")
    r = _rows(d.withColumn("language", lang.language(F.col("language"), F.col("path"))), "path", "body", texts_of)
    return r.groupBy(F.col("key").alias("path"), "nl_lang").agg(F.max("chars").alias("chars"), F.max("share").alias("share"))


def in_symbols(symbols: DataFrame) -> DataFrame:
    """(symbol_id, nl_lang, chars): the largest language of a valid symbol's doc comment."""
    v = latest(symbols, "id", "indexed_at", ["id", "indexed_at", "doc_comment"]).filter(F.length("doc_comment") > 0)
    r = _rows(v.withColumn("language", F.lit(None).cast("string")), "id", "doc_comment", lambda t, _: [(True, re.sub(r"\r\n?", "\n", t))], remember=True)
    return r.groupBy(F.col("key").alias("symbol_id")).agg(F.max_by(F.struct("nl_lang", "chars"), F.struct("chars", F.hex("nl_lang"))).alias("x")).select("symbol_id", "x.nl_lang", "x.chars")


def p6_found(spark, sf_dir: str) -> DataFrame:
    f = in_files(table(spark, sf_dir, "sources"), table(spark, sf_dir, "files"))
    s = in_symbols(table(spark, sf_dir, "symbols"))
    return f.select(F.lit("file").alias("holder"), F.col("path").alias("holder_key"), "nl_lang").unionByName(s.select(F.lit("symbol").alias("holder"), F.col("symbol_id").alias("holder_key"), "nl_lang"))


def p6_shares(spark, sf_dir: str) -> DataFrame:
    """Each language's share of the characters of each file."""
    return in_files(table(spark, sf_dir, "sources"), table(spark, sf_dir, "files")).select("path", "nl_lang", "chars", F.round("share", 6).alias("share"))


QUERIES = {"p6_found": p6_found, "p6_shares": p6_shares}
ORACLES: dict[str, str] = {}
