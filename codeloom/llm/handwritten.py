"""Problem 1: generated, minified and vendored files, and data written as code, told from hand-written source.

A random forest judges each text by what generators leave in it: compression ratio, token entropy, lengths of
identifiers, comment density, and measures of repetition, lines and literals. It is trained anew on every corpus: labels
are the notices in file headers ("code generated by ...", a library's banner), and these headers are cut off before the
features are taken, so that the forest learns the text behind them. Texts without a notice are the other class; as some
of them are generated as well, the forests are fitted twice, the second time without the unlabelled texts that the first
took for cases. Every text is judged by a forest that was fitted on the other half of the corpus.

A path is found if the forest says so, or by evidence that no text behind a header can give: the notice itself, a path
that belongs to third parties or generators, a text that is literals only, and a text that is, by five-word shingles, a
library file of the reference items, whole or slightly changed. `p1_recall` reports what the forest finds of each.

Scale: one Python pass gives everything about whole texts, with the tokens of a batch measured at once (numpy); the forest
scores inside the JVM. It is fitted on a bounded sample of labelled rows (`train_rows`, by hash of the path, half of each
class as far as there are that many). The reference items' shingles are sent to every executor after a check of their
size (`library_bytes`). Nothing is compared pair by pair.

Defined cases: null, empty and blank bodies are no cases by content but may be by path; null paths are dropped; copies
give one row; where a corpus has no labelled text of one of the classes, no forest is fitted and the evidence decides
alone.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources.tables import materialise, table

TRAIN_ROWS, SHINGLE, SIMILARITY, THRESHOLD = 20_000, 5, 0.8, 0.75
FIRST_TREES, TREES, LIKELY, UNLIKELY, LEAF_SHARE, LIBRARY_BYTES = 16, 24, 0.8, 0.5, 0.01, 64_000_000
# Folders that hold third parties' code or generators' output, as whole steps of a path.
VENDOR_STEPS = "node_modules bower_components jspm_packages third_party thirdparty third-party 3rdparty 3rd_party 3rd-party vendor vendored external externals extern Godeps site-packages dist-packages Pods Carthage".split()
GENERATED_STEPS = "generated __generated__ _generated gen autogen auto-generated generated-sources generated-src generated_sources target build dist out".split()
# Names that generators and bundlers give to their files.
FILE_NAMES = [r"[.-]min\.(?:js|css|mjs|cjs)", r"_pb2(?:_grpc)?\.pyi?", r"\.pb(?:\.\w+)?\.(?:go|cc|h|cpp|swift|rs)", r"\.g\.(?:cs|dart)", r"\.(?:gen|generated|designer|g4|freezed|autogen)\.\w+", r"(?:^|[_.-])(?:zz_)?generated\.\w+", r"(?:bundle|chunk|app|main|vendor|runtime|polyfills)[.-][0-9a-f]{6,}\.js", r"\.bundle\.js"]
PATH = re.compile(rf"(?:^|/)(?:{'|'.join(map(re.escape, VENDOR_STEPS + GENERATED_STEPS))})/(?:.*/)?[^/]+$|(?:{'|'.join(FILE_NAMES)})$", re.I)
# What a header notice says, in the words of several tools and languages; a line of a comment must begin so.
NOTICE = re.compile(
    r"""^(?:@generated\b|<auto-?generated|code\ generated\ by\b|generated\ (?:by|from|with|using|automatically)\b|auto-?generated\b(?!\ method\ stub)|automatically\ (?:generated|created|produced)\b
    |(?:this|the\ following)\ (?:file|code|source|module)\ (?:was|is|has\ been)\ (?:\w+\ )?(?:auto-?|automatically\ |machine\ |machine-)?(?:generated|produced|created|written)(?:\ automatically|\ by\ (?:a|the|an)\b|\ from\b)
    |machine[\ -](?:written|generated|made)\b|output\ of\ (?:the|a)\ \S+\ (?:compiler|generator|parser|tool)\b|(?:warning[:!]?\ )?do\ not\ (?:edit|modify)\b(?!.*\bwithout\b)|source:\ \S+\.(?:idl|proto|thrift|fbs|avsc|g4|y|l)\b
    |diese\ datei\ (?:wurde|ist|wird)\ automatisch|automatisch\ (?:erzeugt|generiert)|(?:ce\ )?fichier\ (?:a\ été\ |est\ )?(?:produit|généré|créé)\ automatiquement|(?:este\ )?archivo\ (?:ha\ sido\ |fue\ |se\ ha\ )?(?:generado|creado)\ automáticamente
    |(?:este\ )?(?:arquivo|ficheiro)\ (?:foi\ |é\ )?(?:gerado|criado)\ automaticamente|(?:questo\ )?file\ (?:è\ (?:stato\ )?)?(?:generato|creato)\ automaticamente|(?:dit\ )?bestand\ (?:is|wordt)\ automatisch|(?:этот\ )?файл\ (?:был\ )?(?:создан|сгенерирован)\ автоматически|此文件由.{0,12}自动|(?:本文件|该文件).{0,8}自动生成|このファイルは自動
    |copied\ (?:verbatim\ )?from\ \S+\ v?\d|upstream\ import\ of\b|third[- ]party\ code\b|vendored\ (?:from|copy)\b|imported\ from\ \S+\ v?\d|(?:taken|ported)\ (?:over\ )?from\ \S+\ v?\d|.{1,80}\bbundled\ with\ this\ project\b)""",
    re.I | re.X,
)
BANNER = re.compile(r"\A\s*/\*!\s*[\w.@/-]+\s+v?\d+\.\d[^\n]*?\*/|\A\s*/\*!?\s*[\w.@/-]+\s+v\d+\.\d[^\n]*?\*/")
LINE_MARK = re.compile(r"^\s*#\s*(?:line\s+)?\d+\s+\"[^\"\n]+\.(?:y|l|yy|ll|g4|rl|re|pyx)\"", re.M)
HEADER = re.compile(r"\A(?:\s*(?://[^\n]*|/\*.*?\*/|#(?!include|define|if|pragma|\[)[^\n]*|--\[\[.*?\]\]|--[^\n]*|<!--.*?-->)[ \t]*(?:\n|\Z|(?<=/)))+", re.S)
COMMENTS = re.compile(r"//[^\n]*|/\*.*?\*/|#(?<![\w\"']#)(?!include|\[)[^\n]*|--[^\n]*|\"\"\".*?\"\"\"", re.S)
TOKEN = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\w+|[^\w\s]")
WORD, DIGITS, NAME = re.compile(r"\w+|[^\w\s]"), re.compile(r"\d+"), re.compile(r"[A-Za-z_]\w*")
FEATURES = ["compression", "token_entropy", "identifier_mean", "identifier_std", "comment_density", "line_mean", "line_max", "digits", "blank", "one_letter", "literals", "shapes", "numbered", "neighbours", "chars", "distinct_identifiers"]


def header_of(text: str) -> tuple[str, str]:
    """(comments before the first code, the rest)."""
    m = HEADER.match(text)
    return (m[0], text[m.end() :]) if m else ("", text)


def has_notice(header: str, text: str) -> bool:
    if BANNER.match(text) or LINE_MARK.search(text):
        return True
    return any(NOTICE.match(re.sub(r"^[\s/*#!<-]*(?=<auto|[^\s/*#!<-])|[\s*/>-]+$", "", line)) for line in header.split("\n"))


def _numbered(parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text of each token, number of its word, the distinct words) of a batch of texts."""
    numbers, words = pd.factorize(np.array(list(itertools.chain.from_iterable(parts)), dtype=object)) if any(parts) else (np.zeros(0, np.int64), np.zeros(0, object))
    return np.repeat(np.arange(len(parts)), [len(x) for x in parts]), numbers, list(words)


def features(bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(FEATURES of each text without its header, whether it is mere data): the tokens of all texts are measured at once.

    Mere data: nearly all of the text is literals, their keys and the signs between them, hardly any other word is left.
    """
    n = len(bodies)
    codes = [COMMENTS.sub(" ", b) for b in bodies]
    text, number, words = _numbered([TOKEN.findall(c) for c in codes])
    size = np.array([len(w) for w in words] or [0], float)
    is_name = np.array([w[0].isalpha() or w[0] == "_" for w in words] or [False])
    is_literal = np.array([w[0] in "\"'" or w[0].isdigit() for w in words] or [False])
    is_numbered = np.array([len(w) > 3 and w[-1].isdigit() for w in words] or [False]) & is_name

    def per(weights: np.ndarray, where: np.ndarray = text) -> np.ndarray:
        return np.bincount(where, weights, n)

    total, names = per(np.ones(len(text))), per(is_name[number])
    some, any_name = np.maximum(total, 1), np.maximum(names, 1)
    length = size[number] * is_name[number]
    mean = per(length) / any_name
    deviation = np.sqrt(np.maximum(per(length * size[number]) / any_name - mean**2, 0))
    pairs, count = np.unique(text * max(1, len(words)) + number, return_counts=True)
    owner, word = np.divmod(pairs, max(1, len(words)))
    share = count / some[owner]
    entropy, distinct = per(-share * np.log2(np.maximum(share, 1e-300)), owner), per(is_name[word], owner)
    chars, literal_chars, name_chars = per(size[number]), per(size[number] * is_literal[number]), per(length)
    out = np.zeros((n, len(FEATURES)))
    for k, (body, code) in enumerate(zip(bodies, codes, strict=True)):
        raw = body.encode("utf-8", "replace")
        room = max(1, len(raw))
        out[k, [0, 4, 7, 8, 14]] = (
            len(zlib.compress(raw, 1)) / room, 1 - (len(code) - code.count(" ")) / max(1, len(body) - body.count(" ")),
            (room - len(raw.translate(None, b"0123456789"))) / room, (room - len(raw.translate(None, b" \t\n\r\f\v"))) / room, math.log1p(len(body)),
        )
    parts = [[x for x in map(str.strip, DIGITS.sub("0", c).split("\n")) if x] for c in codes]
    holder, line, lines = _numbered(parts)
    wide = np.array([len(x) for x in lines] or [0], float)
    count_ = np.maximum(per(np.ones(len(holder)), holder), 1)
    longest = np.zeros(n)
    np.maximum.at(longest, holder, wide[line])
    kinds = np.unique(holder * max(1, len(lines)) + line)
    blurred = pd.factorize(np.array(NAME.sub("x", "\n".join(lines)).split("\n"), dtype=object))[0][line] if lines else line
    period = np.zeros(n)
    for j in range(1, 8):  # how often a line is as the one j lines before it
        same = (holder[j:] == holder[:-j]) if len(holder) > j else np.zeros(0, bool)
        if same.any():
            alike = per((blurred[j:] == blurred[:-j])[same], holder[j:][same])
            period = np.maximum(period, alike / np.maximum(count_ - j, 1))
    out[:, 5], out[:, 6], out[:, 11], out[:, 13] = per(wide[line], holder) / count_, np.log1p(longest), per(np.ones(len(kinds)), kinds // max(1, len(lines))) / count_, period
    out[:, 1], out[:, 2], out[:, 3], out[:, 9] = entropy, mean, deviation, per((length == 1) & is_name[number]) / any_name
    out[:, 10], out[:, 12], out[:, 15] = per(is_literal[number]) / some, per(is_numbered[word], owner) / np.maximum(distinct, 1), distinct / any_name
    data = (literal_chars >= 0.6 * chars) & (names <= np.maximum(10, 0.01 * total)) & (name_chars <= 0.1 * chars) & (total > 0)
    return out, data


def shingle_runs(bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the runs of five words (signs count, blanks and line ends don't) in their order. A text of fewer
    words has one run, filled up."""
    parts = [w + [""] * (SHINGLE - len(w)) if w else w for w in map(WORD.findall, bodies)]
    text, number, words = _numbered(parts)
    if len(text) < SHINGLE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words], dtype=np.uint64)[number]
    m = len(a) - SHINGLE + 1
    h = np.zeros(m, np.uint64)
    for i in range(SHINGLE):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + a[i : m + i]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    own = text[:m] == text[SHINGLE - 1 :]
    return text[:m][own], h[own].view(np.int64)


def distinct(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, sorted and each once."""
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])] if len(text) else np.zeros(0, bool)
    return text[new], h[new]


def shingles(bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*shingle_runs(bodies))


class Library:
    """The shingles of the reference items, by hash; `likeness` compares a batch of texts with them."""

    def __init__(self, items: list[str]):
        text, h = shingles(items)
        self.size = np.bincount(text, minlength=len(items))
        order = np.argsort(h, kind="stable")
        self.hash, self.item = h[order], text[order]
        self.low = np.zeros(1 << 22, bool)  # which low bits occur: most runs of other texts fail here
        self.low[self.hash & (len(self.low) - 1)] = True

    def likeness(self, bodies: list[str]) -> np.ndarray:
        """The greatest Jaccard similarity of each text to an item; 0 below SIMILARITY, unless the text holds nearly all of
        an item of about its size."""
        best = np.zeros(len(bodies))
        text, h = shingle_runs(bodies)
        if not len(text) or not len(self.hash):
            return best
        # A text like an item shares more than 0.6 of its runs with it; only texts that share so many at all are compared.
        maybe = np.flatnonzero(self.low[h & (len(self.low) - 1)])
        at = np.minimum(np.searchsorted(self.hash, h[maybe]), len(self.hash) - 1)
        enough = np.bincount(text[maybe], self.hash[at] == h[maybe], len(bodies)) >= 0.6 * self.size.min()
        text, h = distinct(text[enough[text]], h[enough[text]])
        n = np.bincount(text, minlength=len(bodies))
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        hit = np.flatnonzero(hi > lo)
        times = hi[hit] - lo[hit]
        at = np.repeat(lo[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pair, both = np.unique(np.repeat(text[hit], times) * len(self.size) + self.item[at], return_counts=True)
        t, i = np.divmod(pair, len(self.size))
        jaccard, less, more = both / (n[t] + self.size[i] - both), np.minimum(n[t], self.size[i]), np.maximum(n[t], self.size[i])
        alike = (jaccard >= SIMILARITY) | ((both >= 0.9 * less) & (less >= 0.7 * more))
        np.maximum.at(best, t[alike], jaccard[alike])
        return best


def plain(body: str) -> str:
    return re.sub(r"\r\n?", "\n", body.lstrip("\ufeff"))


def described(sources: DataFrame, library: DataFrame, library_bytes: int = LIBRARY_BYTES) -> DataFrame:
    """(path, body_id, notice, by_path, data, lib, feats) of each distinct path and body; lib is the similarity to a library
    file, null if none is like it. The library goes to every executor, so its size is checked."""
    d = sources.filter("path is not null").select("path", F.coalesce("body", F.lit("")).alias("body")).distinct().withColumn("body_id", F.xxhash64("path", "body"))
    names = ["path", "body_id", "notice", "by_path", "data", "lib", "feats"]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.float64(), pa.list_(pa.float64())]
    items = library.filter("body is not null and body <> ''").select("body").distinct()
    if (items.agg(F.sum(F.octet_length("body"))).first()[0] or 0) > library_bytes:
        raise ValueError(f"the library has more than {library_bytes} bytes: compare with parts of it one after the other")
    shared = sources.sparkSession.sparkContext.broadcast(Library([plain(r.body) for r in items.collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                texts = [plain(x) for x in b.column("body").to_pylist()]
                heads = [header_of(t) for t in texts]
                f, data = features([rest for _, rest in heads])
                lib = shared.value.likeness(texts)
                code = [bool(rest.strip()) for _, rest in heads]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("path"), b.column("body_id"), pa.array([has_notice(h, t) for (h, _), t in zip(heads, texts, strict=True)], types[2]), pa.array([bool(PATH.search(p)) for p in b.column("path").to_pylist()], types[3]),
                        pa.array([bool(x) and c for x, c in zip(data, code, strict=True)], types[4]), pa.array([float(x) if x else None for x in lib], types[5]), pa.array([x if c else None for x, c in zip(f.tolist(), code, strict=True)], types[6]),
                    ],
                    names=names,
                )

    return d.select("path", "body", "body_id").mapInArrow(run, "path string, body_id long, notice boolean, by_path boolean, data boolean, lib double, feats array<double>")


def fit(labelled: DataFrame, train_rows: int, trees: int, seed: int = 7):
    """A random forest over (x, label), from at most `train_rows` rows, half of each class as far as there are; None if
    one class is missing."""
    from pyspark.ml.classification import RandomForestClassifier

    count = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(count) < 2:
        return None
    half = train_rows / 2
    keep = {k: min(1.0, max(half, train_rows - min(half, count[1.0 - k])) / n) for k, n in count.items()}
    part = F.pmod(F.xxhash64("body_id", F.lit(seed)), F.lit(1_000_000)) / 1e6
    sample = labelled.filter(part < F.when(F.col("label") == 1, keep[1.0]).otherwise(keep[0.0]))
    weight = F.when(F.col("label") == 1, 1.0 / max(1, count[1.0] * keep[1.0])).otherwise(1.0 / max(1, count[0.0] * keep[0.0])) * F.lit(float(min(train_rows, sum(count.values()))) / 2)
    return RandomForestClassifier(numTrees=trees, maxDepth=7, minInstancesPerNode=max(3, int(LEAF_SHARE * min(train_rows, sum(count.values())))), seed=seed, labelCol="label", featuresCol="x", weightCol="w", featureSubsetStrategy="sqrt").fit(sample.select("x", "label", weight.alias("w"), "body_id").repartition(4, "body_id").sortWithinPartitions("body_id").drop("body_id"))  # the same parts in the same order: the same forest


def _out_of_fold(labelled: DataFrame, rows: DataFrame, train_rows: int, trees: int) -> DataFrame | None:
    """`rows` with p: each half judged by the forest that was fitted on the other half's labels; None if a half lacks a class."""
    from pyspark.ml.functions import vector_to_array

    folds = [fit(labelled.filter(f"fold = {k}"), train_rows // 2, trees) for k in (0, 1)]
    if None in folds:
        model = fit(labelled, train_rows, trees)
        folds = [model, model]
    if None in folds:
        return None
    scored = folds[1].transform(rows.filter("fold = 0")).unionByName(folds[0].transform(rows.filter("fold = 1")))
    return scored.withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, "p")


def judged(sources: DataFrame, library: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(path, body_id, notice, by_path, data, lib, p): all evidence for each distinct path and body; p is the probability
    that the text isn't hand-written, by a forest that hasn't seen the text's label (null for a text without code)."""
    from pyspark.ml.functions import array_to_vector

    t = materialise(described(sources, library))
    fold = F.pmod(F.xxhash64("body_id", F.lit(11)), F.lit(2)).alias("fold")
    x = t.filter("feats is not null").select("path", "body_id", "notice", "by_path", "lib", array_to_vector("feats").alias("x"), fold)
    labels = x.filter("notice or (not by_path and lib is null)").select("body_id", "x", "fold", F.col("notice").cast("double").alias("label"))
    first = _out_of_fold(labels, labels, train_rows, FIRST_TREES)
    if first is None:
        return t.select("path", "body_id", "notice", "by_path", "data", "lib", F.lit(None).cast("double").alias("p"))
    # Once more, without the unlabelled texts that look like cases and without notices on what looks hand-written. As the
    # classes weigh the same, a text as common among labelled as among other texts has about a half. Half of the notices
    # stand on texts that nothing else tells from hand-written ones; large leaves keep these below what is likely.
    clean = materialise(first.filter(F.when(F.col("label") == 1, F.col("p") >= LIKELY).otherwise(F.col("p") < UNLIKELY)).drop("p"))
    p = _out_of_fold(clean, x, train_rows, TREES)
    p = _out_of_fold(labels, x, train_rows, TREES) if p is None else p
    return t.drop("feats").join(p.select("path", "body_id", "p"), ["path", "body_id"], "left")


def evidence(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "sources"), table(spark, sf_dir, "library_files"))


IS_CASE = f"p >= {THRESHOLD} or notice or by_path or data or lib is not null"


def p1_found(spark, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).filter(IS_CASE).select("path").distinct()


def p1_evidence(spark, sf_dir: str) -> DataFrame:
    """What speaks for each path that was found."""
    return evidence(spark, sf_dir).filter(IS_CASE).groupBy("path").agg(F.max("notice").alias("notice"), F.max("by_path").alias("by_path"), F.max("data").alias("data"), F.max("lib").alias("library_similarity"), F.max("p").alias("forest"))


def p1_recall(spark, sf_dir: str) -> DataFrame:
    """(evidence, texts, by_forest): of the texts with each evidence, how many a forest that hasn't seen their labels finds."""
    e = evidence(spark, sf_dir)
    kinds = F.array(*[F.when(c, F.lit(n)) for n, c in (("notice", F.col("notice")), ("path", F.col("by_path")), ("data", F.col("data")), ("library", F.col("lib").isNotNull()), ("none", F.expr("not (notice or by_path or data or lib is not null)")))])
    return e.select(F.explode(F.array_compact(kinds)).alias("evidence"), (F.coalesce("p", F.lit(0.0)) >= THRESHOLD).cast("long").alias("f")).groupBy("evidence").agg(F.count("*").alias("texts"), F.sum("f").alias("by_forest"))


QUERIES = {"p1_found": p1_found, "p1_evidence": p1_evidence, "p1_recall": p1_recall}
ORACLES: dict[str, str] = {}
