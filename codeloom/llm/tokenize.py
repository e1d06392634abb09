"""Problem 7: every text as token ids of a public byte-level BPE encoding.

Speculate and verify. A word (as the encoding's pattern splits) is first cut greedily into the longest tokens. Such a
cut is the encoding's own result exactly when each two neighbours are compatible, that is, when merging their bytes
gives the two again; compatibility is read off the merge table by undoing last merges on both sides of the seam, and
that test runs vectorised over all seams of all new words of a batch. Only words with a bad seam are merged exactly.

Scale: one narrow pass, no shuffle. The tables are built once per Python worker from the public vocabulary file, whose
folder is a parameter and must exist on every executor (`tokenizer_dir`). Words are remembered up to `CACHE_WORDS`
per worker and the memory is dropped beyond; that changes speed only.

Defined cases: null and empty text give an empty list; texts aren't trimmed, normalised or cut, and strings of special
tokens are ordinary text. Lone surrogates can't occur in Parquet's UTF-8.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources.tables import table

TOKENIZER_DIR = os.environ.get("CODELOOM_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern of the encoding; it splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 300_000
NONE = np.int64(1 << 40)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    def __init__(self, vocabulary_file: str):
        import regex

        with open(vocabulary_file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in model["vocab"] if all(c in letters for c in token)}
        vocab = model["vocab"]
        self.ids = {raw[t]: i for t, i in vocab.items() if t in raw}
        n = max(self.ids.values()) + 1
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)  # a byte's halves are itself
        self.rank: dict[tuple[int, int], int] = {}
        pairs = []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            pairs.append((x, y, z))
            self.rank[x, y] = z
            self.left[z], self.right[z] = x, y
        p = np.array(pairs, dtype=np.int64)
        key = p[:, 0] << 32 | p[:, 1]
        order = np.argsort(key)
        self.pair_keys, self.pair_ids = key[order], p[order, 2]
        self.longest = max(map(len, self.ids))
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, np.ndarray] = {}
        # Where no longer token begins with these bytes, the search for the longest needn't go on.
        self.prefixes = {t[:k] for t in self.ids for k in range(1, len(t))}

    def _combined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id each pair merges into, or NONE."""
        key = a << 32 | b
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.pair_ids[i], NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b stay apart when their bytes are merged together; all pairs at once.

        A merge across the seam would happen before the later of the two tokens' own last merges; so the last merges
        are undone one after the other, newest first, looking for a pair at the seam that would have merged earlier.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        good, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), NONE)
        while len(live):
            x, y, lim = a[live], b[live], limit[live]
            bad = self._combined(x, y) < lim
            good[live[bad]] = False
            newest_left = x > y
            next_limit = np.where(newest_left, x, y + 1)
            nx, ny = np.where(newest_left, self.right[x], x), np.where(newest_left, y, self.left[y])
            # A byte can't be undone; then the other side's turn comes, and if that is a byte too, the pair is done.
            stuck_l = newest_left & (nx == x)
            nl = np.where(stuck_l, y + 1, next_limit)
            ny = np.where(stuck_l, self.left[y], ny)
            end_l = stuck_l & (ny == y)
            stuck_r = ~newest_left & (ny == y)
            nl = np.where(stuck_r, x, nl)
            nx = np.where(stuck_r, self.right[x], nx)
            end_r = stuck_r & (nx == x)
            a[live], b[live], limit[live] = nx, ny, nl
            live = live[~(bad | end_l | end_r)]
        return good

    def greedy(self, word: bytes) -> list[int]:
        ids, prefixes, out, i, n = self.ids, self.prefixes, [], 0, len(word)
        while i < n:
            j, end, token = i + 1, i + 1, ids[word[i : i + 1]]
            while j < n and word[i:j] in prefixes:
                j += 1
                if (t := ids.get(word[i:j])) is not None:
                    token, end = t, j
            out.append(token)
            i = end
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merges by rank with a heap over a linked list: n log n also for very long words."""
        tok: list[int | None] = [self.ids[word[i : i + 1]] for i in range(len(word))]
        nxt, prv = [*range(1, len(tok)), -1], [*range(-1, len(tok) - 1)]
        heap = [(r, i, i + 1) for i in range(len(tok) - 1) if (r := self.rank.get((tok[i], tok[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            if tok[i] is None or tok[j] is None or nxt[i] != j or self.rank.get((tok[i], tok[j])) != r:
                continue
            tok[i], tok[j], nxt[i] = r, None, nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
                if (s := self.rank.get((r, tok[nxt[i]]))) is not None:
                    heapq.heappush(heap, (s, i, nxt[i]))
            if prv[i] >= 0 and (s := self.rank.get((tok[prv[i]], r))) is not None:
                heapq.heappush(heap, (s, prv[i], i))
        return [t for t in tok if t is not None]

    def learn(self, words: list[str]) -> None:
        """Encodes new words: proposals for all, one vectorised check of every seam, exact merging of the failed."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        cuts = [self.greedy(b) for b in raw]
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = np.fromiter((t for c in cuts for t in c), np.int64, int(sizes.sum()))
        word_of = np.repeat(np.arange(len(cuts)), sizes)
        seam = np.flatnonzero(word_of[1:] == word_of[:-1])
        pair, back = np.unique(flat[seam] << 32 | flat[seam + 1], return_inverse=True)
        fine = self.compatible(pair >> 32, pair & 0xFFFFFFFF)[back] if len(pair) else np.ones(0, bool)
        failed = set(word_of[seam[~fine]].tolist())
        self.checked = (len(words), len(failed))
        for i, w in enumerate(words):
            self.known[w] = np.array(self.exact(raw[i]) if i in failed else cuts[i], dtype=np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, flat ids) of the texts."""
        words = [self.split(t) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        if new := list({w for ws in words for w in ws} - self.known.keys()):
            self.learn(new)
        known = self.known
        parts = [[known[w] for w in ws] for ws in words]
        sizes = np.fromiter((sum(map(len, p)) for p in parts), np.int64, len(parts))
        every = [x for p in parts for x in p]
        return sizes, np.concatenate(every) if every else np.zeros(0, np.int32)


@functools.lru_cache(maxsize=2)
def bpe(vocabulary_file: str) -> ByteBPE:
    return ByteBPE(vocabulary_file)


def _slices(batch: pa.RecordBatch, column: str, max_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of characters, or a single text."""
    chars, start = 0, 0
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(sizes):
        if i > start and chars + n > max_chars:
            yield batch.slice(start, i - start)
            start, chars = i, 0
        chars += n
    if start < batch.num_rows:
        yield batch.slice(start)


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", tokenizer_dir: str = TOKENIZER_DIR, name: str = "byte_bpe_50k.json") -> DataFrame:
    """Adds (or replaces) the column `out`, the list of token ids of `text`; all other columns and rows stay."""
    import pyarrow.compute  # noqa: F401

    rest = [c for c in df.columns if c != out]
    file, schema = os.path.join(tokenizer_dir, name), df.select(*rest).withColumn(out, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        enc = bpe(file)
        for whole in batches:
            for b in _slices(whole, text):
                sizes, flat = enc.encode(b.column(text).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*rest, out])

    return df.select(*rest).mapInArrow(run, schema)


def p7_ids(spark, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


QUERIES = {"p7_ids": p7_ids}
ORACLES: dict[str, str] = {}
