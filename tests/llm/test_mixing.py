import collections
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm.mixing import deal, indexed, mix, pack, permute, plan_sizes, shares
from codeloom.llm.tokenize import TOKENIZER_DIR, bpe

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json")), reason="public vocabulary files are not here")


def test_permute_is_a_permutation_that_depends_on_the_key():
    for n in (1, 2, 3, 10, 1000, 1025):
        a, b = (permute(np.arange(n), np.full(n, n), np.full(n, k)) for k in (5, -7))
        assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(n))
    assert a.tolist() != b.tolist() != sorted(b.tolist())


def test_plan_hits_the_shares_within_the_caps():
    p = plan_sizes([("a", 0.5, 1, 51_200, 100), ("b", 0.25, 4, 5_120, 10), ("c", 0.25, 9, 0, 0), ("d", 0.0, 1, 9, 1)])
    assert [(s, n, k) for s, _, n, k in p] == [("a", 100, 80), ("b", 10, 40)]
    assert plan_sizes([]) == []


def test_shards_are_drawn_alike_from_any_range():
    totals, per = np.array([8_000, 3_210, 0, 17]), 100
    shards = -(-int(totals.sum()) // per)
    whole = deal(totals, shards, per, range(shards))
    first, count = whole[:, 0], whole[:, 1]
    assert (count.sum(0) == totals).all() and (count >= 0).all()
    assert (count[:-1].sum(1) == per).all() and count[-1].sum() == totals.sum() - per * (shards - 1)
    assert (first == np.cumsum(count, 0) - count).all()
    for part in (range(0, 1), range(3, 50), range(shards - 1, shards)):
        assert (deal(totals, shards, per, part) == whole[part.start : part.stop]).all()
    # The counts of the shards vary as draws do, about their shares.
    spread = count[:-1, 0].std() / np.sqrt(per * 0.71 * 0.29)
    assert 0.7 < spread < 1.3 and abs(count[:-1, 0].mean() - per * 8_000 / totals.sum()) < 1


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, f"Text {i} about the index and its {i % 7} shards. " * (1 + i % 5), "big" if i % 4 else "small") for i in range(120)]
    rows += [(200, None, "big"), (201, "", "small"), (202, "no source", None), (203, "not wanted", "other"), (3, rows[3][1], "big")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("block", F.lit(1)).withColumn("ids", F.lit("x"))
    t = spark.createDataFrame([("big", 0.4, 1), ("small", 0.4, 3), ("none", 0.2, 2)], "source string, target_share double, max_repeats int")
    return d, t, rows


def test_blocks_hold_every_token_once(tables):
    d, t, rows = tables
    enc = bpe(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json"))
    for chunk in (10**6, 300):
        b = indexed(pack(d, t, 16, chunk)).collect()
        for s in ("big", "small"):
            own = [r for r in b if r.source == s]
            assert sorted(r.idx for r in own) == list(range(len(own)))
            want = collections.Counter(x for _, text, q in rows if q == s and text for x in enc.encode([text])[1].tolist())
            assert collections.Counter(x for r in own for x in r.ids) == want
            assert all(r.n_tokens == len(r.ids) <= 16 for r in own)
            texts = {i: text for i, text, _ in rows if i != 3}
            for r in own[:40]:  # each piece is where its document has it
                at = 0
                for x in r.pieces:
                    if x.doc_id in texts:
                        assert r.ids[at : at + x.n] == enc.encode([texts[x.doc_id]])[1].tolist()[x.at : x.at + x.n]
                    at += x.n
                assert at == r.n_tokens


def test_mixture_and_shares(tables):
    d, t, _ = tables
    m, sources = mix(d, t, 16, shard_blocks=40)
    got = m.collect()
    assert len({r.shard for r in got}) > 3
    blocks = {s[0]: s[4] for s in sources}
    uses = collections.Counter((r.source, r.idx) for r in got)
    assert max(v for (s, _), v in uses.items() if s == "big") == 1
    assert max(v for (s, _), v in uses.items() if s == "small") <= 3
    assert {s for s, _ in uses} == {"big", "small"} and len(got) > blocks["small"]
    assert len({(r.shard, r.slot) for r in got}) == len(got)
    r = {x.source: x for x in shares(m, t).collect()}
    assert abs(r["big"].actual_share - 0.5) < 0.03 and abs(r["small"].actual_share - 0.5) < 0.03
    assert r["none"].tokens == 0 and r["none"].target_share == 0.2
    empty, _ = mix(d.limit(0), t)
    assert empty.count() == 0 and shares(empty, t).filter("tokens > 0").count() == 0
