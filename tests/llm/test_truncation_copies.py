"""Copies of a text don't vouch for it, nor do texts that only share a tail or a rare word."""

from codeloom.llm.truncation import closing, judge, truncated


def found(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return sorted(r.doc_id for r in truncated(d).collect())


def test_a_repeated_truncated_text(spark):
    whole = [(10_000 + i, f"Text {'ab'[i % 2]}{i} is whole.", "chat") for i in range(200)]
    cut = [(i, "Hi.\n\nThe first ru" + "\n" * (i % 3), "chat") for i in range(300)]
    title = [(1000 + i, "The output of sess", "chat") for i in range(300)]
    assert found(spark, whole + cut + title) == [*range(300), *range(1000, 1300)]


def test_different_texts_vouch(spark):
    rows = [(i, f"Text {chr(97 + i)} is whole.\n\nSee you then", "mail") for i in range(9)]
    assert found(spark, rows) == []
    assert found(spark, rows[:4]) == [0, 1, 2, 3]  # three others are too few


def test_the_whole_last_line_counts():
    a, b = (judge(f"All of it.\n\n- https://x.org/{c * 20}/{'y' * 90}") for c in "xz")
    assert a[0] == b[0] == "doubtful" and a[1] != b[1] and a[1][0] == b[1][0] == "~"


def test_a_word_needs_a_share_of_the_texts(spark):
    cut = (1, "The rest of the tok", "wiki")
    holds = [(10 + i, f"Text {chr(97 + i)} has a tok.\nIt ends.", "wiki") for i in range(3)]
    d = spark.createDataFrame([cut, *holds], "doc_id long, text string, source string")
    assert truncated(d).count() == 0
    assert [r.doc_id for r in truncated(d, word_share=0.9).collect()] == [1]  # three of four texts


def test_a_text_does_not_vouch_for_its_own_word(spark):
    own = (1, "A tok.\n\n- one tok", "wiki")
    holds = [(10 + i, f"Text {chr(97 + i)} has a tok.\nIt ends.", "wiki") for i in range(2)]
    assert "tok" in closing("A tok.\n\n- one tok") and "tok" not in closing("A token.\n\n- one tok")
    assert found(spark, [own, *holds]) == [1]
