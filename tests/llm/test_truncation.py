import pytest
from pyspark.sql import functions as F

from codeloom.llm.truncation import judge, p9_rates, truncated

CASES = [
    ("The index is rebuilt.", "whole"), ("The index is reb", "cut-or-doubt"), ("First it loads. Then the shard ind", "cut"), ("A\n\n```py\nx = 1\n", "cut"), ("A\n\n```py\nx = 1\n```", "whole"),
    ("A\n\n~~~\n```\n~~~", "whole"), ("A\n\n````\n```\n", "cut"), ("It reads `walk_gr", "cut"), ("Sessions, tags, and so on…", "whole"), ("Well, we will have to wait and see...", "whole"), ("It was then cl [truncated]", "cut"),
    ("It was read (more)", "cut"), ("All is well. The output [...]", "cut"), ("Good.\n\nCheers", "whole"), ("Good.\n\n+1", "whole"), ("Good.\n\n| a | 1 |", "whole"), ("Good.\n\nDigest: 0123456789abcdef01", "whole"),
    ("", "whole"), (" \n", "whole"), ("書き込む前にロックします。", "whole"), ("何も見つからない場合は、以前の値をそ", "cut-or-doubt"), ("Done now. 👍", "whole"), ("Older than &am", "cut"), ("Kaputt �", "cut"), ("x. " * 200_000 + "and th", "cut"),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_judge(text, want):
    v = judge(text)[0]
    assert (v in ("cut", "doubtful")) if want == "cut-or-doubt" else v == want


def test_found_with_baseline_nulls_ties_and_clashing_columns(spark, tmp_path):
    rows = [(i, f"Line {i} of the marker.\n\n- token\n- marker", "wiki") for i in range(8)]
    rows += [(100, "A text about it.\n\n- token\n- mar", "wiki"), (101, "Cut in the mid", None), (101, "Cut in the mid", None), (102, None, "wiki"), (103, "", "wiki"), (104, "All well.", None), (105, "It stops. Then it wen", "mail")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("shape", F.lit(1)).withColumn("word", F.lit("x"))
    assert sorted(r.doc_id for r in truncated(d).collect()) == [100, 101, 101, 105]
    assert truncated(d.limit(0)).count() == 0
    d.write.parquet(f"{tmp_path}/documents.parquet")
    rates = {r.source: (r.documents, r.texts, r.truncated) for r in p9_rates(spark, str(tmp_path)).collect()}
    assert rates == {"wiki": (11, 10, 1), None: (3, 3, 2), "mail": (1, 1, 1)}


OPEN = ["He wrote (see the\n\nNext para ends fine.", "<div><p>Hello there.", 'A json {"a": 1.', 'He said "we go. Now.', "It reads `walk now.", "« Il dit. Et puis.", "[a](b and so on.\n\n- x"]
SHUT = ["He wrote (see it) :) there.", "a) first, b) second.", "<br>Hello <b>there</b>.", 'He said "we go". Now.', "```\nif (x {\n```\nDone.", "Use `f(` with care.", "It is `Vec::<T>` or a::<t>() here.", "5 < 6 and 7 > 2.", "It ends ) here."]


@pytest.mark.parametrize(("text", "want"), [(t, True) for t in OPEN] + [(t, False) for t in SHUT])
def test_what_is_open_at_the_end(spark, text, want):
    others = [(i, f"Whole text number {i}.", "wiki") for i in range(30)]
    d = spark.createDataFrame([*others, (99, text, "wiki")], "doc_id long, text string, source string")
    assert [r.doc_id for r in truncated(d).collect()] == ([99] if want else [])


def test_signs_that_a_source_leaves_open_are_usual_there(spark):
    rows = [(i, f"Smile ( {i}\n\nIt ends here {i}.", "chat") for i in range(30)] + [(100, "Smile ( x\n\nIt ends here.", "mail")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r.doc_id for r in truncated(d).collect()] == [100]
