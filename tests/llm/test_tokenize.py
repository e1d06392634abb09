import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import tokenize
from codeloom.llm.tokenize import PATTERN, TOKENIZER_DIR, bpe, encode_texts

RANKS = os.path.join(TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="public vocabulary files are not here")


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json"))


def ids(own, text):
    return own.encode([text])[1].tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(own, plain, text):
    assert ids(own, text) == plain.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehinorstu ABT.,'_-0129\n\t", max_size=80))
def test_near_words(own, plain, text):
    assert ids(own, text) == plain.encode_ordinary(text)


def test_speculation_is_mostly_right_and_the_check_finds_the_rest(own, plain):
    own.known.clear()
    text = "def walk_scope_symbol(self): return NonExistentThing(indexing, reordered, unhappiness, supercalifragilistic)"
    assert ids(own, text) == plain.encode_ordinary(text)
    words, failed = own.checked
    assert words > 10 and failed < words


def test_long_word_and_small_cache(own, plain, monkeypatch):
    monkeypatch.setattr(tokenize, "CACHE_WORDS", 3)
    for text in ("ab" * 20_000, "索引" * 3_000, "<|endoftext|>", " \n \r\n\t ", "á‍👩‍💻�"):
        assert ids(own, text) == plain.encode_ordinary(text)


def test_nulls_empty_extra_columns_and_empty_table(spark, plain):
    d = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "Hallo Welt", 7), (None, "x", 8)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id or 0, r.ids) for r in encode_texts(d).collect())
    assert got == [(0, plain.encode_ordinary("x")), (1, []), (2, []), (2, plain.encode_ordinary("Hallo Welt"))]
    assert encode_texts(d.limit(0)).count() == 0
