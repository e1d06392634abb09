"""Source trees as tables: walking, ignore rules, hashes, line windows, sidecar metadata and front matter."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import lang
from codeloom.operators.tags import glob_regex

# The comment sign before front matter, by language.
COMMENT = {"python": "#", "bash": "#", "yaml": "#", "toml": "#", "elixir": "#", "hcl": "#", "sql": "--", "lua": "--", "haskell": "--"}
# Defaults: the mark that begins front matter and the name of sidecars; an index made by another tool names its own.
FRONT_MARK, FRONT_LINES, SIDECAR = "@codeloom", 50, ".codeloom.yml"


def ignore_pattern(rules: str) -> str | None:
    """One pattern for the lines of an ignore file: names at any depth, rooted paths, folders; without negations."""
    out = []
    for line in rules.splitlines():
        g = line.strip()
        if not g or g.startswith(("#", "!")):
            continue
        folder, rooted = g.endswith("/"), "/" in g.rstrip("/")
        x = glob_regex(g.strip("/"))
        if x:
            out.append(("" if rooted else "(?:.*/)?") + x[1:-1].replace(".*", "[^/]*" if "**" not in g else ".*") + ("/.*" if folder else "(?:/.*)?"))
    return f"^(?:{'|'.join(out)})$" if out else None


def walk(spark: SparkSession, root: str, ignore: str | None = None) -> DataFrame:
    """(path relative to the root, language, size, modified, content_hash, body) of the source files below a folder.

    Hidden files and folders, ignored paths and unknown extensions are left out before a body is read as text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(re.sub(r"^file:/*", "/", root).rstrip("/"))
    d = files.withColumn("path", F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), f"^.*?{base}/", ""))
    d = d.filter(~F.col("path").rlike(r"(?:^|/)\.") & lang.extension(F.col("path")).isin(list(lang.EXTENSIONS)))
    if ignore and (p := ignore_pattern(ignore)):
        d = d.filter(~F.col("path").rlike(p))
    return d.select("path", lang.language(F.lit(None).cast("string"), F.col("path")).alias("language"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.md5("content").alias("content_hash"), F.decode("content", "UTF-8").alias("body"))


def window(body: Column, first: int, last: int) -> Column:
    """Numbered lines of a text from first to last."""
    lines = F.slice(F.split(F.regexp_replace(body, r"\r\n?", "\n"), "\n"), first, last - first + 1)
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + first).cast("string"), 4, " "), F.lit(" | "), x)), "\n")


def front_matter(body: str, language: str | None, mark: str = FRONT_MARK) -> dict | None:
    """Metadata in the comments of the first lines: a mark, then 'key: value' lines up to a line that is none."""
    import yaml

    sign, out, on = COMMENT.get(language or "", "//"), [], False
    for line in body.lstrip("﻿").splitlines()[:FRONT_LINES]:
        s = line.strip()
        if not s.startswith(sign):
            if on:
                break
            continue
        t = s[len(sign) :].strip()
        if mark in t:
            on = True
        elif on:
            if ":" not in t:
                break
            out.append(t)
    try:
        found = yaml.safe_load("\n".join(out)) if out else None
    except yaml.YAMLError:
        return None
    return found if isinstance(found, dict) else None


META = "path string, doc string, purpose string, stability string, owner string, tags array<string>"


def _meta(path: str, m: dict) -> tuple:
    text = lambda k: None if m.get(k) is None else str(m[k])
    tags = m.get("tags") or []
    return path, text("doc1") or text("doc"), text("purpose"), text("stability"), text("owner"), [str(t) for t in tags] if isinstance(tags, list) else [str(tags)]


def sidecar_rows(path: str, body: str) -> list[tuple]:
    """A sidecar's files: folder tags come before a file's own, each once; a malformed sidecar has none."""
    import yaml

    try:
        t = yaml.safe_load(body)
    except yaml.YAMLError:
        return []
    if not isinstance(t, dict):
        return []
    folder = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
    common = [str(x) for x in t.get("directory_tags") or []]
    out = []
    for name, m in (t.get("files") or {}).items():
        row = _meta(folder + str(name), m if isinstance(m, dict) else {})
        out.append((*row[:5], list(dict.fromkeys(common + row[5]))))
    return out


def file_meta(texts: DataFrame, sidecar: str = SIDECAR, mark: str = FRONT_MARK) -> DataFrame:
    """Metadata of (path, body, language): rows of sidecars, and of files with front matter; a sidecar goes first."""
    names = [x.split()[0] for x in META.split(", ")] + ["rank"]
    types = [pa.string()] * 5 + [pa.list_(pa.string()), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, t, lg in zip(*(b.column(c).to_pylist() for c in ("path", "body", "language")), strict=True):
                if p.rsplit("/", 1)[-1] == sidecar:
                    rows += [(*r, 0) for r in sidecar_rows(p, t)]
                elif (m := front_matter(t, lg, mark)) is not None:
                    rows.append((*_meta(p, m), 1))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    r = texts.filter("path is not null and body is not null").select("path", "body", "language").mapInArrow(run, META + ", rank int")
    best = r.groupBy("path").agg(F.min(F.struct("rank", *names[1:-1])).alias("m"))
    return best.select("path", *[F.col(f"m.{c}").alias(c) for c in names[1:-1]])
