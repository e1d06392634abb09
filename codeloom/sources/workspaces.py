"""Workspaces: the members of a repository, their kinds and what they use of one another, and versions from lock files.

A repository's manifests are few and small, so each repository is read in one task; repositories are spread.
"""

from __future__ import annotations

import json
import re
import tomllib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.tags import glob_regex
from codeloom.sources.extract import MANIFEST, manifests, workspace_kind
from codeloom.sources.tables import table

MODULES = "root string, workspace string, module string, path string, module_type string, internal_dependencies array<string>"


def _expand(pattern: str, folders: list[str]) -> list[str]:
    """The folders a member pattern names: itself, those right below `x/*`, those anywhere below `x/**`."""
    pattern = re.sub(r"^\./|/$", "", pattern)
    if "*" not in pattern:
        return [pattern] if pattern in folders else []
    deep = pattern.endswith("**")
    x = re.compile(glob_regex(pattern) if deep else glob_regex(pattern).replace(".*", "[^/]*"))
    return [f for f in folders if x.match(f)]


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except ValueError:
        return {}


def _json(text: str) -> dict:
    try:
        t = json.loads(text)
    except ValueError:
        return {}
    return t if isinstance(t, dict) else {}


def modules(files: dict[str, str]) -> tuple[str, list[tuple]]:
    """(kind of workspace, [(module, path, type, internal dependencies)]) of a repository's files by relative path."""
    kind = workspace_kind(list(files), files)
    folder_of = lambda name: sorted(p[: -len(name) - 1] for p in files if p.endswith("/" + name))
    out: list[tuple] = []
    if kind == "cargo":
        root = _toml(files["Cargo.toml"])
        members = [f for p in root.get("workspace", {}).get("members", []) for f in _expand(p, folder_of("Cargo.toml"))]
        for f in dict.fromkeys(members):
            t = _toml(files[f"{f}/Cargo.toml"])
            lib, main = f"{f}/src/lib.rs" in files, f"{f}/src/main.rs" in files
            uses = sorted({k for s in ("dependencies", "dev-dependencies", "build-dependencies") for k, v in (t.get(s) or {}).items() if isinstance(v, dict) and "path" in v})
            out.append((t.get("package", {}).get("name", f.rsplit("/", 1)[-1]), f, "application" if lib and main else "binary" if main else "library", uses))
    elif kind == "gradle":
        settings = files.get("settings.gradle.kts") or files.get("settings.gradle") or ""
        paths = [p for line in re.findall(r"(?m)^\s*include\b(.*)$", settings) for p in re.findall(r"[\"']:?([^\"']+)[\"']", line)]
        for p in dict.fromkeys(paths):
            f = p.replace(":", "/")
            build = files.get(f"{f}/build.gradle.kts") or files.get(f"{f}/build.gradle") or ""
            used = re.findall(r"project\(\s*(?:path\s*[:=]\s*)?[\"']:?([^\"']+)[\"']", build)
            out.append((p.replace(":", "-"), f, "application" if re.search(r"\bapplication\b", build) else "library", sorted({u.replace(":", "-") for u in used if any(q == u or q.endswith(":" + u) for q in paths)})))
    elif kind in ("npm", "pnpm"):
        w = _json(files.get("package.json", "")).get("workspaces") or []
        patterns = (w.get("packages", []) if isinstance(w, dict) else w) or re.findall(r"(?m)^\s*-\s*[\"']?([^\"'\n]+?)[\"']?\s*$", files.get("pnpm-workspace.yaml", ""))
        found = list(dict.fromkeys(f for p in patterns for f in _expand(p, folder_of("package.json")) if "node_modules" not in f.split("/")))
        own = {f: _json(files[f"{f}/package.json"]) for f in found}
        names = {t.get("name", f) for f, t in own.items()}
        for f, t in own.items():
            uses = sorted({k for s in ("dependencies", "devDependencies", "peerDependencies") for k in (t.get(s) or {}) if k in names})
            out.append((t.get("name", f), f, "application" if "bin" in t or "start" in (t.get("scripts") or {}) else "library", uses))
    return kind, out


def workspaces(texts: DataFrame) -> DataFrame:
    """The modules of each repository, from its manifests: `texts` is (root, path, body) with paths relative to the root."""
    schema = pa.schema([("root", pa.string()), ("workspace", pa.string()), ("module", pa.string()), ("path", pa.string()), ("module_type", pa.string()), ("internal_dependencies", pa.list_(pa.string()))])

    def solve(t: pa.Table) -> pa.Table:
        kind, found = modules(dict(zip(t.column("path").to_pylist(), (x or "" for x in t.column("body").to_pylist()), strict=True)))
        rows = [(t.column("root")[0].as_py(), kind, *m) for m in found] or [(t.column("root")[0].as_py(), kind, None, None, None, None)]
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return texts.filter("root is not null and path is not null").select("root", "path", "body").groupBy("root").applyInArrow(solve, MODULES)


def lock_versions(texts: DataFrame) -> DataFrame:
    """(root, name, version) from Cargo.lock (the last entry of a name wins) and installed node_modules."""
    cargo = texts.filter("path = 'Cargo.lock'").select("root", F.posexplode(F.regexp_extract_all("body", F.lit(r"\[\[package\]\]\s+name = \"([^\"]+)\"\s+version = \"[^\"]+\""), F.lit(0))).alias("i", "x"))
    cargo = cargo.select("root", "i", F.regexp_extract("x", 'name = "([^"]+)"', 1).alias("name"), F.regexp_extract("x", 'version = "([^"]+)"', 1).alias("version"))
    cargo = cargo.groupBy("root", "name").agg(F.max_by("version", "i").alias("version"))
    npm = texts.filter(F.col("path").rlike(r"^node_modules/(?:@[^/]+/)?[^/]+/package\.json$")).select("root", F.regexp_extract("path", r"^node_modules/(.+)/package\.json$", 1).alias("name"), F.get_json_object("body", "$.version").alias("version"))
    return cargo.unionByName(npm.filter("version is not null"))


def locked_manifests(texts: DataFrame) -> DataFrame:
    """The dependencies of manifests with the versions that are locked or installed, where they are."""
    m = manifests(texts.select(F.concat_ws("\1", "root", "path").alias("path"), "body")).withColumn("root", F.substring_index("path", "\1", 1)).withColumn("path", F.substring_index("path", "\1", -1))
    v = lock_versions(texts).select("root", F.col("name").alias("dependency"), F.col("version").alias("locked"))
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    return m.join(v, ["root", "dependency"], "left").withColumn("dependency_version", F.coalesce("locked", "dependency_version")).select("root", *names)


def _made(s, d):
    """Repositories made of the projects' ids: a workspace of each kind in turn."""
    nl = "char(10)"
    forms = {
        0: [("Cargo.toml", f"concat('[workspace]', {nl}, 'members = [\"crates/*\", \"tool\"]')"), ("crates/a/Cargo.toml", f"concat('[package]', {nl}, 'name = \"a', id, '\"', {nl}, '[dependencies]', {nl}, 'serde = \"1\"', {nl}, '[dependencies.b]', {nl}, 'path = \"../b\"')"), ("crates/b/Cargo.toml", f"concat('[package]', {nl}, 'name = \"b\"')"), ("crates/b/src/lib.rs", "''"), ("crates/b/src/main.rs", "''"), ("tool/Cargo.toml", f"concat('[package]', {nl}, 'name = \"tool\"')"), ("tool/src/main.rs", "''"), ("crates/deep/x/Cargo.toml", "''"), ("Cargo.lock", f"concat('[[package]]', {nl}, 'name = \"serde\"', {nl}, 'version = \"1.0.1\"', {nl}, '[[package]]', {nl}, 'name = \"serde\"', {nl}, 'version = \"1.0.', id, '\"')")],
        1: [("settings.gradle.kts", f"concat('include(\":app\")', {nl}, 'include(\":lib:core\")')"), ("app/build.gradle.kts", f"concat('plugins {{ application }}', {nl}, 'implementation(project(\":lib:core\"))')"), ("lib/core/build.gradle.kts", "''")],
        2: [("package.json", "'{\"name\": \"r\", \"workspaces\": [\"packages/*\"]}'"), ("packages/x/package.json", "concat('{\"name\": \"@s/x', id, '\", \"scripts\": {\"start\": \"y\"}, \"dependencies\": {\"@s/y\": \"*\", \"left\": \"^1\"}}')"), ("packages/y/package.json", "'{\"name\": \"@s/y\"}'"), ("node_modules/left/package.json", "'{\"version\": \"1.2.3\"}'")],
        3: [("pom.xml", "'<modules><module>m</module></modules>'")],
    }
    p = table(s, d, "projects").select("id").distinct()
    out = None
    for k, files in forms.items():
        f = p.filter(f"id % 4 = {k}").select(F.concat(F.lit("r"), "id").alias("root"), F.explode(F.array(*[F.struct(F.lit(n).alias("path"), F.expr(x).alias("body")) for n, x in files])).alias("x")).select("root", "x.path", "x.body")
        out = f if out is None else out.unionByName(f)
    return out


QUERIES = {
    "workspace_modules": lambda s, d: workspaces(_made(s, d)).withColumn("internal_dependencies", F.array_join("internal_dependencies", ",")),
    "locked_dependencies": lambda s, d: locked_manifests(_made(s, d)).select("root", "path", "dependency", "dependency_version", "is_dev"),
}
ORACLES = {
    "workspace_modules": "WITH p AS (SELECT DISTINCT id, concat('r', id) AS root FROM projects) SELECT root, workspace, module, path, module_type, internal_dependencies FROM ("
    "SELECT root, 'cargo' AS workspace, concat('a', id) AS module, 'crates/a' AS path, 'library' AS module_type, 'b' AS internal_dependencies FROM p WHERE id % 4 = 0 UNION ALL SELECT root, 'cargo', 'b', 'crates/b', 'application', '' FROM p WHERE id % 4 = 0 UNION ALL SELECT root, 'cargo', 'tool', 'tool', 'binary', '' FROM p WHERE id % 4 = 0"
    " UNION ALL SELECT root, 'gradle', 'app', 'app', 'application', 'lib-core' FROM p WHERE id % 4 = 1 UNION ALL SELECT root, 'gradle', 'lib-core', 'lib/core', 'library', '' FROM p WHERE id % 4 = 1"
    " UNION ALL SELECT root, 'npm', concat('@s/x', id), 'packages/x', 'application', '@s/y' FROM p WHERE id % 4 = 2 UNION ALL SELECT root, 'npm', '@s/y', 'packages/y', 'library', '' FROM p WHERE id % 4 = 2 UNION ALL SELECT root, 'maven', NULL, NULL, NULL, NULL FROM p WHERE id % 4 = 3)",
    "locked_dependencies": "WITH p AS (SELECT DISTINCT id, concat('r', id) AS root FROM projects) SELECT root, 'crates/a/Cargo.toml' AS path, 'serde' AS dependency, concat('1.0.', id) AS dependency_version, FALSE AS is_dev FROM p WHERE id % 4 = 0 UNION ALL SELECT root, 'crates/a/Cargo.toml', 'b', '*', FALSE FROM p WHERE id % 4 = 0 UNION ALL SELECT root, 'packages/x/package.json', '@s/y', '*', FALSE FROM p WHERE id % 4 = 2 UNION ALL SELECT root, 'packages/x/package.json', 'left', '1.2.3', FALSE FROM p WHERE id % 4 = 2",
}
