import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm.handwritten import FEATURES, PATH, THRESHOLD, Library, described, features, has_notice, header_of, judged, shingles

NOTICES = ["// Code generated by x 1.2. DO NOT EDIT.", "# @generated by y", "// <auto-generated>", "/*! lib v1.2 | X */", "// Diese Datei wurde automatisch erzeugt, bitte nicht ändern.", "// 此文件由工具自动生成。", "#line 3 \"a.y\"", "// Copied from lib 1.2.3, see upstream", "// lib 1.2.3 by the lib contributors, bundled with this project unchanged"]
PLAIN = ["// Emits the banner that says \"Code generated by x, DO NOT EDIT\" into it.", "// Keys are generated by the allocator, so never edit their order.", "/// Auto-generated method stub", "// Copyright 2025 The Authors", "// Unlike the library of the same purpose, this one was written here from scratch."]


@pytest.mark.parametrize(("line", "want"), [(x, True) for x in NOTICES] + [(x, False) for x in PLAIN])
def test_notices(line, want):
    text = f"{line}\nfn a() {{}}\n"
    assert has_notice(header_of(text)[0], text) is want
    assert not has_notice(*[header_of(f"fn a() {{}}\n{line}\n")[0]] * 2) or line.startswith("#line")


@pytest.mark.parametrize(("path", "want"), [("a/node_modules/x/b.js", True), ("a/src/c.min.js", True), ("a/x_pb2.py", True), ("a/gen/src/x.rs", True), ("a/src/app.0a1b2c3d.js", True), ("a/x.gen.ts", True), ("a/src/vendors/x.rs", False), ("a/dist_lock/x.rs", False), ("a/src/generator/x.rs", False), ("a/parser_generated_test.py", False), ("a/external_ids/x.go", False), ("a/tools/codegen/x.go", False)])
def test_paths(path, want):
    assert bool(PATH.search(path)) is want


def test_data():
    data = ["TABLE = [\n" + ", ".join(map(str, range(10_000, 10_400))) + "]", 'static final String[] P = {\n"' + "q8/P+nQ" * 60 + '",\n};', 'X = ["abc", "def"]']
    code = ["fn a() { let w = [1, 2, 3]; return w; }\n" * 20, "", "x = y + z\n"]
    assert features(data + code)[1].tolist() == [True] * 3 + [False] * 3


def test_features_of_a_text_do_not_depend_on_the_batch():
    r = random.Random(8)
    texts = [hand(r, i) for i in range(5)] + ["", "x" * 300_000, "a\n\n# only\n", "1 2 3"]
    whole = features(texts)[0]
    assert whole.shape == (9, len(FEATURES))
    for i, t in enumerate(texts):
        assert np.allclose(features([t])[0][0], whole[i])


def hand(r, i):
    names = [r.choice("walk scan load rank fold emit pack trim".split()) + r.choice("Edge Node Scope Tag Route".split()) for _ in range(9)]
    body = [f"import {{ {r.choice(names)} }} from './{r.choice('abc')}';"]
    for n in names:
        body.append(f"/** {r.choice(['Keeps', 'Drops', 'Finds'])} the {r.choice('edge node scope tag'.split())} that {r.choice(['was', 'is'])} {r.choice(['left', 'new', 'old'])}. */\nexport function {n}(a: number): number {{")
        body += [r.choice([f"  if (a > {r.randint(1, 99)}) return {r.choice('ab')};", f"  let {r.choice(['total', 'rest', 'depth'])} = a {r.choice('+-*')} {r.randint(1, 99)};", f"  console.log('{r.choice(['x', 'locked', 'done'])}');"]) for _ in range(r.randint(2, 6))] + ["  return a;\n}"]
    return "\n".join(body)


def machine(r, i):
    stem = r.choice(["visitEdge", "ruleTag", "caseNode"])
    return "".join(f"export function {stem}{k:03d}(a: number): number {{\n  return a + {r.randint(1, 9999)};\n}}\n" for k in range(r.randint(20, 60)))


def test_forest_finds_what_the_notices_do_not_say(spark):
    r = random.Random(3)
    rows = [(f"h{i}.ts", hand(r, i), False) for i in range(500)] + [(f"n{i}.ts", "// Code generated by x. DO NOT EDIT.\n" + machine(r, i), True) for i in range(160)] + [(f"m{i}.ts", machine(r, i), True) for i in range(80)]
    lib = spark.createDataFrame([(1, "l", "1", "l.ts", "typescript", hand(random.Random(99), 0))], "lib_file_id long, lib_name string, lib_version string, file_name string, language string, body string")
    s = spark.createDataFrame([(p, b) for p, b, _ in rows] + [("null.ts", None), ("empty.ts", ""), ("vendor/x.ts", None), (None, "x"), (rows[0][0], rows[0][1]), ("copy.ts", "﻿" + lib.first().body.replace("\n", "\r\n") + "\nexport const z = 1;")], "path string, body string").withColumn("notice", F.lit(1))
    j = {x.path: x for x in judged(s, lib).collect()}
    assert len(j) == len(rows) + 4
    wrong = [p for p, _, want in rows if (j[p].p >= THRESHOLD) != want]
    assert len(wrong) <= 0.02 * len(rows), wrong
    assert j["copy.ts"].lib > 0.9 and j["h1.ts"].lib is None and j["vendor/x.ts"].by_path and j["null.ts"].p is None
    assert judged(s.limit(0), lib).count() == 0
    assert judged(s.filter("path like 'h%'"), lib.limit(0)).filter("p is not null").count() == 0


def test_library_similarity_equals_brute_force(spark):
    r = random.Random(5)
    texts = [hand(r, i) for i in range(6)]
    texts += [texts[0].replace("total", "sum", 1), texts[1][: len(texts[1]) // 2], "", "one two"]
    sets = [set(shingles([t])[1].tolist()) for t in texts]
    got = Library(texts[:3]).likeness(texts)
    for a, x in zip(sets, got, strict=True):
        best = max((len(a & b) / len(a | b) for b in sets[:3] if a and b), default=0.0)
        assert (x == pytest.approx(best)) if best >= 0.8 else x == 0 or x == pytest.approx(best)
    assert Library([]).likeness(texts).tolist() == [0.0] * len(texts)
    lib = spark.createDataFrame([(t,) for t in texts[:3]], "body string")
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, body string")
    assert {x.path for x in described(d, lib).filter("lib is not null").collect()} == {str(i) for i, x in enumerate(got) if x}
    with pytest.raises(ValueError, match="library"):
        described(d, lib, 10)
