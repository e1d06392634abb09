"""Problem 8: documents of several sources mixed to target weights.

Texts are encoded, and each source's tokens are packed into blocks of a fixed length. The mixture is as large as it can
be while every source that has documents contributes exactly its share (shares of sources without documents are spread
over the others in proportion) and none is repeated more than max_repeats times. Its block slots are dealt to output
shards of `shard_blocks` by multinomial draws, conditioned on the sources' totals; the slots of a source are then numbered through, and
number u is the block perm(u mod N) of pass u div N, where perm is a pseudorandom permutation of the source's N blocks
made anew for each pass (a Feistel network with cycle walking, evaluated for whole columns). Slots join blocks by index.

Scale: a source that holds a third of all tokens is packed in many chunks of `chunk_tokens`, by a hash of the document,
so that no window or group holds more than a chunk. The join is by (source, block), which is even. Shards are drawn in
Spark, any range of them on its own, by halving the totals down to the shard; the driver holds a row for each source.

Defined cases: null and empty texts have no tokens; null sources, sources without a target and targets without
documents take no part (the latter are reported with no tokens); the last block of a chunk may be short, its tokens
count as they are; repeated texts are documents of their own; an empty table gives a report without tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.tokenize import TOKENIZER_DIR, encode_texts
from codeloom.sources.tables import materialise, table

BLOCK, CHUNK_TOKENS, SHARD_BLOCKS, SEED = 512, 4_000_000, 1_000, 20250101


def pack(documents: DataFrame, targets: DataFrame, block: int = BLOCK, chunk_tokens: int = CHUNK_TOKENS, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(source, chunk, block, n_tokens, ids, pieces): the tokens of each source with a target, in blocks of `block` tokens.

    A block is the concatenation of pieces of documents in the order of a hash of their ids; `pieces` says, in order, of
    which document each is, from which of its tokens on, and how many: (doc_id, at, n).
    """
    wanted = targets.filter("source is not null").select("source").distinct()
    d = documents.filter("source is not null and text is not null and text <> ''").select("doc_id", "source", "text").join(wanted, "source", "left_semi")
    d = materialise(encode_texts(d, tokenizer_dir=tokenizer_dir).select("doc_id", "source", "ids", F.size("ids").alias("n")))
    # One row per source with a target: bounded by the table of targets.
    chunks = d.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / chunk_tokens)).cast("int").alias("chunks"))
    d = d.join(chunks, "source").withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.col("chunks")).cast("int"))
    order = Window.partitionBy("source", "chunk").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("ids")).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("start", F.coalesce(F.sum("n").over(order), F.lit(0)))
    piece = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n") - 1) / block))).alias("block")
    d = d.filter("n > 0").select("source", "chunk", "doc_id", "start", "n", "ids", piece)
    first, last = F.greatest(F.col("block") * block - F.col("start"), F.lit(0)), F.least(F.col("n").cast("long"), (F.col("block") + 1) * block - F.col("start"))
    parts = d.select("source", "chunk", "block", F.struct("start", "doc_id", first.cast("int").alias("at"), F.slice("ids", (first + 1).cast("int"), (last - first).cast("int")).alias("ids")).alias("piece"))
    whole = parts.groupBy("source", "chunk", "block").agg(F.array_sort(F.collect_list("piece")).alias("p"))
    pieces = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["at"].alias("at"), F.size(x["ids"]).alias("n")))
    return whole.select("source", "chunk", "block", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), pieces.alias("pieces")).withColumn("n_tokens", F.size("ids"))


def indexed(blocks: DataFrame) -> DataFrame:
    """Adds idx, 0 to N-1 within the source: the chunk's offset and the block's place in it."""
    per = blocks.groupBy("source", "chunk").agg(F.count("*").alias("c"))
    base = per.withColumn("base", F.coalesce(F.sum("c").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return blocks.join(base.drop("c"), ["source", "chunk"]).withColumn("idx", F.col("base") + F.col("block")).drop("base")


def plan_sizes(sources: list[tuple], block: int = BLOCK) -> list[tuple]:
    """[(source, weight, N, blocks drawn)] from [(source, share, max_repeats, tokens, N)].

    The common size is the largest one at which no source exceeds its cap; blocks are counted at the source's mean size.
    """
    live = [s for s in sources if s[3] and s[4] and s[1] and s[1] > 0 and (s[2] or 0) > 0]
    total = sum(s[1] for s in live)
    if not live:
        return []
    size = min(s[3] * s[2] * total / s[1] for s in live)
    return [(s[0], s[1] / total, s[4], min(int(s[4] * s[2]), max(1, round(size * s[1] / total * s[4] / s[3])))) for s in live]


def split(count: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """A multinomial draw of `take` of sum(count) things, by their shares, conditioned on no kind giving more than it has:
    what a kind can't give is drawn again from the others."""
    got = np.zeros(len(count), np.int64)
    while (left := take - int(got.sum())) > 0:
        room = count - got
        got += np.minimum(rng.multinomial(left, room / room.sum()), room)
    return got


def deal(totals: np.ndarray, shards: int, per_shard: int, wanted: range, seed: int = SEED) -> np.ndarray:
    """[shard in wanted][first slot number, slots][source]: each shard's source counts and how many slots of the source lie
    in the shards before it.

    The shards are halved again and again; each half gets a multinomial draw of its parent's counts, by a generator that
    is seeded with the half's place. Any range of shards can so be dealt anywhere, with the same result.
    """
    out = np.zeros((len(wanted), 2, len(totals)), np.int64)
    todo = [(0, shards, np.asarray(totals, np.int64), np.zeros(len(totals), np.int64))]
    while todo:
        lo, hi, count, first = todo.pop()
        if hi <= wanted.start or lo >= wanted.stop:
            continue
        if hi - lo == 1:
            out[lo - wanted.start] = first, count
            continue
        mid = (lo + hi) // 2
        left = split(count, min((mid - lo) * per_shard, int(count.sum())), np.random.default_rng([seed, lo, hi]))
        todo += [(lo, mid, left, first), (mid, hi, count - left, first + left)]
    return out


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key: a Feistel network on the next even power of two, walked on
    until the value falls below the size."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(np.float64))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, k = index.astype(np.uint64), key.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for r in range(rounds):
            h = (right + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15) + k[todo]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            left, right = right, left ^ (h & mask[todo])
        x[todo] = left << half[todo] | right
        todo[todo] = x[todo] >= size[todo].astype(np.uint64)
    return x.astype(np.int64)


def mix(documents: DataFrame, targets: DataFrame, block: int = BLOCK, chunk_tokens: int = CHUNK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, tokenizer_dir: str = TOKENIZER_DIR) -> tuple[DataFrame, list[tuple]]:
    """The mixture (shard, slot, source, pass, idx, n_tokens, ids, pieces), and [(source, share, repeats, tokens, blocks)]."""
    spark = documents.sparkSession
    t = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    blocks = materialise(indexed(pack(documents, targets, block, chunk_tokens, tokenizer_dir)))
    stats = t.join(blocks.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("blocks")), "source", "left")
    rows = stats.collect()  # a row per source of the targets: what the caller lists by hand
    sources = sorted((r.source, r.share, r.repeats, r.tokens or 0, r.blocks or 0) for r in rows)
    sizes = plan_sizes(sources, block)
    totals = np.array([x[3] for x in sizes], dtype=np.int64)
    shards = int(-(-totals.sum() // shard_blocks))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_pylist()
            if not ids:
                continue
            first, count = deal(totals, shards, shard_blocks, range(ids[0], ids[-1] + 1), seed).transpose(1, 0, 2)
            i, j = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(i + ids[0]), pa.array([sizes[x][0] for x in j], pa.string()), pa.array([int(sizes[x][2]) for x in j], pa.int64()), pa.array(first[i, j]), pa.array(count[i, j])], names=["shard", "source", "size", "first", "slots"])

    # Shards are drawn in Spark; a shard has at most shard_blocks slots, so no row explodes into more.
    plan = spark.range(0, shards, 1, max(1, min(2000, shards // 500))).mapInArrow(draw, "shard long, source string, size long, first long, slots long")
    slots = plan.select("shard", "source", "size", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("slots") - 1)).alias("u"))
    slots = slots.withColumn("pass", F.floor(F.col("u") / F.col("size")))

    @F.pandas_udf("long")
    def place(u: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permute((u % size).to_numpy(), size.to_numpy(), key.to_numpy()))

    slots = slots.withColumn("idx", place("u", "size", F.xxhash64("source", "pass", F.lit(seed)))).withColumn("slot", F.xxhash64("shard", "source", "u", F.lit(seed)))
    mixed = slots.join(blocks.select("source", "idx", "n_tokens", "ids", "pieces"), ["source", "idx"])
    return mixed.select("shard", "slot", "source", F.col("pass").cast("int").alias("pass"), "idx", "n_tokens", "ids", "pieces"), sources


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, blocks, times): what each source of the targets contributes; times is
    the number of passes begun over its blocks."""
    t = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    m = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("blocks"), (F.max("pass") + 1).alias("times"))
    all_ = F.sum("tokens").over(Window.partitionBy())  # a row per source
    return t.join(m, "source", "left").select("source", "target_share", F.round(F.coalesce(F.col("tokens") / F.greatest(all_, F.lit(1)), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("times", F.lit(0)).alias("times"))


def p8_mixture(spark, sf_dir: str) -> DataFrame:
    """The mixture itself, block by block; `slot` orders the blocks of a shard."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return shares(mix(table(spark, sf_dir, "documents"), targets)[0], targets)


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares}
ORACLES: dict[str, str] = {}
