"""References to records that do not exist at the time of the reference.

Keys are partitioned into ranges: cuts are taken from a sample of the parents' keys, in their order. The parents of a
range are stored once, as arrays sorted by (key, start); batches of references are probed against them by vectorised
binary search, and the misses come out.

Scale: the number of ranges follows the number of parent intervals, up to MAX_RANGES cuts that are sent to every executor.
A key that many references share (a third of all rows) makes one range hot on the reference side only, so the ranges
are split by salt in proportion to their references and the range's arrays are copied to each salt. No range is ever
gathered beyond some `parents_per_range` intervals plus those of one key, and these are merged beforehand.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.tables import clean_path, latest, materialise, micros, table

OPEN_END = (1 << 63) - 1


def existence(df: DataFrame, key: Column, start: Column, end: Column) -> DataFrame:
    """(key, start, end): the disjoint times, in microseconds, in which a row with the key existed.

    Start is inclusive, end exclusive, a null end is open. Rows without key or start never existed; neither did those
    that end before they start. Copies and overlaps are merged by a running maximum, which spills and needs no
    memory for the group.
    """
    spans = (
        df.select(key.alias("key"), micros(start).alias("start"), F.coalesce(micros(end), F.lit(OPEN_END)).alias("end"))
        .filter("key is not null and start is not null and end > start")
        .distinct()
    )
    w = Window.partitionBy("key").orderBy("start", "end")
    seen = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.withColumn("new", (seen.isNull() | (F.col("start") > seen)).cast("int"))
        .withColumn("run", F.sum("new").over(w))
        .groupBy("key", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .select("key", "start", "end")
    )


def coded(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key, the distinct keys)."""
    d = keys.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_numpy(zero_copy_only=False).astype(object)


def probe(parents: np.ndarray, starts: np.ndarray, ends: np.ndarray, refs: pa.Array, at: np.ndarray, known: np.ndarray) -> np.ndarray:
    """True where no interval of the key holds the time. `parents` (keys), `starts` and `ends` are sorted by (key, start),
    and the intervals of a key are disjoint. `known` is False where the time is null: then nothing existed."""
    if not len(parents):
        return np.ones(len(refs), bool)
    distinct, first = np.unique(parents, return_index=True)
    last = np.append(first[1:], len(parents))
    code, asked = coded(refs)
    place = np.minimum(np.searchsorted(distinct, asked), len(distinct) - 1)
    there = (distinct[place] == asked)[code]
    begin, stop = first[place][code], last[place][code]
    lo, hi = begin.copy(), stop.copy()
    # The key's last interval with start <= at: a binary search in all references' intervals at once.
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        right = open_ & (starts[np.minimum(mid, len(starts) - 1)] <= at)
        lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
    i = np.maximum(lo - 1, 0)
    return ~(there & known & (lo > begin) & (ends[i] > at))


MAX_RANGES, SAMPLED = 100_000, 16


def cuts_of(parents: DataFrame, ranges: int, n: int) -> np.ndarray:
    """At most ranges - 1 keys that cut the parents' keys, in their order, into ranges of about one size. Taken from a
    sample by hash, some SAMPLED keys for each range; they decide only how even the ranges are."""
    if ranges < 2:
        return np.zeros(0, object)
    share = min(1.0, ranges * SAMPLED / n)
    keys = sorted(r.k for r in parents.filter(F.pmod(F.xxhash64("k", F.lit(3)), F.lit(1_000_000)) < share * 1_000_000).select("k").distinct().collect())
    return np.array(keys[:: max(1, len(keys) // ranges)][1:], dtype=object)


def missing(references: DataFrame, parents: DataFrame, parents_per_range: int = 5_000, references_per_probe: int = 20_000) -> DataFrame:
    """Rows of `references` (ref_field, key, symbol_id, at) whose key has no interval in `parents` (ref_field, key,
    start, end) that holds `at` (microseconds). Null keys are no references; a null time is never held.

    Returns references' rows as they are, one for each row.
    """
    parents = materialise(parents.select(F.concat_ws("\0", "ref_field", "key").alias("k"), "start", "end"))
    n = parents.count()  # a number; decides only how finely the ranges are cut
    cuts = cuts_of(parents, min(MAX_RANGES, -(-n // parents_per_range)), n)

    @F.pandas_udf("int")
    def part_of(k: pd.Series) -> pd.Series:
        code, distinct = coded(pa.array(k, pa.string()))
        return pd.Series(np.searchsorted(cuts, distinct, "right")[code])

    part = part_of("k") if len(cuts) else F.lit(0)
    refs = references.filter(F.col("key").isNotNull()).withColumn("k", F.concat_ws("\0", "ref_field", "key")).withColumn("part", part)
    # A row per range: as many as there are ranges, so its size is proven by MAX_RANGES.
    salts = F.broadcast(refs.groupBy("part").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / references_per_probe)).cast("int").alias("salts")))
    refs = refs.join(salts, "part").withColumn("salt", F.pmod(F.xxhash64("symbol_id", "at"), F.col("salts")).cast("int")).drop("salts")
    arrays = (
        parents.withColumn("part", part)
        .groupBy("part")
        .agg(F.array_sort(F.collect_list(F.struct("k", "start", "end"))).alias("a"))
        .join(salts, "part")
        .select("part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *[F.col(f"a.{c}").alias(f"p_{c}") for c in ("k", "start", "end")])
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        own = {c: right.column(f"p_{c}").combine_chunks().flatten().to_numpy(zero_copy_only=False) if right.num_rows else np.zeros(0, object if c == "k" else np.int64) for c in ("k", "start", "end")}
        at = left.column("at").combine_chunks()
        miss = probe(own["k"].astype(object), own["start"], own["end"], left.column("k").combine_chunks(), at.fill_null(0).to_numpy(zero_copy_only=False), ~at.is_null().to_numpy(zero_copy_only=False))
        return left.select(["ref_field", "key", "symbol_id", "at"]).filter(pa.array(miss))

    schema = references.select("ref_field", "key", "symbol_id", "at").schema
    return refs.groupBy("part", "salt").cogroup(arrays.groupBy("part", "salt")).applyInArrow(search, schema)


def _valid_symbols(symbols: DataFrame) -> DataFrame:
    return latest(symbols, "id", "indexed_at", ["id", "indexed_at", "file_path", "dependency_id"])


def symbol_references(symbols: DataFrame) -> DataFrame:
    """(ref_field, key, symbol_id, at) of the valid symbols' non-null references."""
    return (
        _valid_symbols(symbols)
        .select(
            F.col("id").alias("symbol_id"),
            micros(F.col("indexed_at")).alias("at"),
            F.explode(F.array(F.struct(F.lit("file_path").alias("ref_field"), clean_path(F.col("file_path")).alias("key")), F.struct(F.lit("dependency_id").alias("ref_field"), F.col("dependency_id").cast("string").alias("key")))).alias("r"),
        )
        .select("r.ref_field", "r.key", "symbol_id", "at")
        .filter("key is not null")
    )


def symbol_parents(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    return (
        existence(files, clean_path(F.col("path")), F.col("indexed_at"), F.col("deleted_at"))
        .withColumn("ref_field", F.lit("file_path"))
        .unionByName(existence(dependencies, F.col("id").cast("string"), F.col("added_at"), F.col("removed_at")).withColumn("ref_field", F.lit("dependency_id")))
    )


def orphan_references(symbols: DataFrame, files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(ref_field, symbol_id, at) of each valid symbol's reference whose target didn't exist at its indexed_at."""
    return missing(symbol_references(symbols), symbol_parents(files, dependencies))


def orphan_report(symbols: DataFrame, files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """References and misses per field and month (first day; null where the symbol has no time)."""
    refs = symbol_references(symbols)
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("month")
    bad = missing(refs, symbol_parents(files, dependencies)).groupBy("ref_field", month).agg(F.count("*").alias("missing"))
    return (
        refs.groupBy("ref_field", month)
        .agg(F.count("*").alias("refs"))
        .unionByName(bad.withColumn("refs", F.lit(0).cast("long")), allowMissingColumns=True)
        .groupBy("ref_field", "month")
        .agg(F.sum("refs").alias("refs"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"))
    )


def p3_found(spark, sf_dir: str) -> DataFrame:
    t = [table(spark, sf_dir, n) for n in ("symbols", "files", "dependencies")]
    return orphan_references(*t).select("ref_field", "symbol_id")


def p3_report(spark, sf_dir: str) -> DataFrame:
    return orphan_report(*[table(spark, sf_dir, n) for n in ("symbols", "files", "dependencies")])


_REFS = """WITH v AS (SELECT * FROM (SELECT id, indexed_at, file_path, dependency_id, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, file_path DESC NULLS LAST, dependency_id DESC NULLS LAST) AS rn FROM symbols WHERE id IS NOT NULL) WHERE rn = 1),
clean AS (SELECT *, regexp_replace(regexp_replace(replace(file_path, chr(92), '/'), '/{2,}', '/', 'g'), '^(\\./)+', '') AS p FROM v),
miss AS (SELECT 'file_path' AS ref_field, id AS symbol_id, indexed_at FROM clean c WHERE p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM files f WHERE f.path = c.p AND f.indexed_at <= c.indexed_at AND (f.deleted_at IS NULL OR f.deleted_at > c.indexed_at))
UNION ALL SELECT 'dependency_id', id, indexed_at FROM clean c WHERE dependency_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dependencies d WHERE d.id = c.dependency_id AND d.added_at <= c.indexed_at AND (d.removed_at IS NULL OR d.removed_at > c.indexed_at)))
"""
QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
ORACLES = {
    "p3_found": _REFS + "SELECT ref_field, symbol_id FROM miss",
    "p3_report": _REFS + """, refs AS (SELECT 'file_path' AS ref_field, indexed_at FROM clean WHERE p IS NOT NULL UNION ALL SELECT 'dependency_id', indexed_at FROM clean WHERE dependency_id IS NOT NULL)
SELECT ref_field, month, sum(r)::BIGINT AS refs, sum(m)::BIGINT AS missing FROM (SELECT ref_field, strftime(indexed_at, '%Y-%m') AS month, 1 AS r, 0 AS m FROM refs UNION ALL SELECT ref_field, strftime(indexed_at, '%Y-%m'), 0, 1 FROM miss) GROUP BY 1, 2""",
}
