import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codeloom.operators.orphans import missing, orphan_references

T0 = datetime(2025, 1, 1)


def test_matches_brute_force_with_a_hot_key_and_small_ranges(spark):
    r = random.Random(5)
    keys = [f"k{i}" for i in range(40)]
    parents, seen = [], {}
    for k in keys:
        t = 0
        for _ in range(r.randint(0, 4)):
            a = t + r.randint(1, 50)
            t = a + r.randint(1, 50)
            parents.append(("f", k, a, t))
            seen.setdefault(k, []).append((a, t))
    refs = [("f", "k1" if r.random() < 0.4 else r.choice([*keys, "nowhere"]), f"s{i}", r.choice([None, r.randint(0, 250)])) for i in range(600)]
    p = spark.createDataFrame(parents, "ref_field string, key string, start long, end long")
    d = spark.createDataFrame(refs, "ref_field string, key string, symbol_id string, at long")
    want = sorted(s for _, k, s, at in refs if at is None or not any(a <= at < b for a, b in seen.get(k, [])))
    for per_range, per_probe in ((5, 10), (10**6, 10**6)):
        assert sorted(x.symbol_id for x in missing(d, p, per_range, per_probe).collect()) == want


def test_edges_of_existence_spelling_states_and_nulls(spark):
    d = lambda n: T0 + timedelta(days=n)
    symbols = spark.createDataFrame(
        [
            ("in", d(5), "./a//b.rs", 1), ("old", d(1), "gone.rs", None), ("old", d(6), "a/b.rs", None), ("at_start", d(2), "a\\b.rs", None), ("at_end", d(9), "a/b.rs", None),
            ("case", d(5), "A/b.rs", 2), ("null", d(5), None, None), ("no_time", None, "a/b.rs", 1), (None, d(5), "x", 7), ("in", d(5), "./a//b.rs", 1), ("blank", d(5), "", None),
        ],
        "id string, indexed_at timestamp, file_path string, dependency_id long",
    ).withColumn("key", F.lit("clash"))
    files = spark.createDataFrame([("a/b.rs", d(2), d(4)), ("a/b.rs", d(3), d(9)), ("a/b.rs", d(3), d(9)), (None, d(1), None), ("a/b.rs", None, None), ("z", d(9), d(8))], "path string, indexed_at timestamp, deleted_at timestamp")
    deps = spark.createDataFrame([(1, d(0), None), (2, d(6), None)], "id long, added_at timestamp, removed_at timestamp")
    got = sorted((r.symbol_id, r.ref_field) for r in orphan_references(symbols, files, deps).collect())
    assert got == sorted([("at_end", "file_path"), ("case", "file_path"), ("case", "dependency_id"), ("no_time", "file_path"), ("no_time", "dependency_id"), ("blank", "file_path")])
    assert orphan_references(symbols.limit(0), files, deps).count() == 0
    assert orphan_references(symbols, files.limit(0), deps.limit(0)).filter("symbol_id = 'in'").count() == 2
