import random

import pytest

from codeloom.operators.hierarchy import forest, hierarchy


def brute(parents):
    out = {}
    for n in parents:
        chain, x = [n], n
        while parents.get(x) in parents and parents[x] is not None and parents[x] not in chain:
            x = parents[x]
            chain.append(x)
        nxt = parents.get(x)
        if nxt is not None and nxt in parents:
            out[n] = (min(chain[chain.index(nxt):]), -1, None)
        else:
            out[n] = (x, len(chain) - 1, chain[::-1])
    return out


def graph(seed, n):
    r = random.Random(seed)
    ids = [f"k{i:03d}" for i in range(n)]
    parents = {}
    for i, x in enumerate(ids):
        parents[x] = r.choice([None, "gone", *[r.choice(ids)] * 6, *[ids[max(0, i - 1)]] * 6])
    return parents


@pytest.mark.parametrize(("seed", "rows"), [(1, 10**6), (2, 7), (3, 7), (4, 25), (5, 3)])
def test_forest_matches_brute_force(spark, seed, rows):
    parents = graph(seed, 90)
    df = spark.createDataFrame([(k, v, hash(k) % 5) for k, v in parents.items()], "node string, parent string, loc long").repartition(3)
    got = {r.node: (r.root, r.depth, r.path) for r in forest(df, True, rows).collect()}
    assert got == brute(parents)


def test_long_chain_and_long_circle(spark):
    parents = {f"c{i:04d}": f"c{i - 1:04d}" if i else None for i in range(300)} | {f"r{i:04d}": f"r{(i + 1) % 200:04d}" for i in range(200)} | {"t1": "r0007", "t2": "t1"}
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(parents.items())], "node string, parent string, loc long").repartition(4)
    for rows in (20, 10**6):
        got = {r.node: (r.root, r.depth) for r in forest(df, False, rows).collect()}
        assert got == {k: v[:2] for k, v in brute(parents).items()}


def test_states_copies_nulls_and_empty_tables(spark):
    s = spark.createDataFrame(
        [("a", None, "f", "2025-01-01"), ("a", "z", "f", "2024-01-01"), ("b", "a", "f", "2025-01-01"), ("b", "a", "f", "2025-01-01"), ("c", "", "f", None), (None, "a", "f", "2025-01-01"), ("d", "d", None, "2025-01-01")],
        "id string, parent string, file_path string, indexed_at string",
    ).withColumn("parent_extra", __import__("pyspark.sql.functions").sql.functions.lit(1))
    n = spark.createDataFrame([], "id string, parent_id string, path string, updated_at timestamp")
    got = {r.node: (r.root, r.depth) for r in hierarchy(s, n).collect()}
    assert got == {"sa": ("sa", 0), "sb": ("sa", 1), "sc": ("sc", 0), "sd": ("sd", -1)}
    assert hierarchy(s.limit(0), n).count() == 0
