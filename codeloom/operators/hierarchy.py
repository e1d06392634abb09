"""Parent-child links to full hierarchies: root, depth, path and descendants of every node, circles reported.

Every node has one parent at most, so the links are a forest plus circles. Three steps:

1. Weighted disjoint-set forests over bounded chunks of links (`rows_per_forest`), one chunk after the other within a
   partition. Each node gets its local top and the offset to it; all finds of a chunk run at once (numpy), with path
   compression that adds up the offsets.
2. The tops whose parent lies in another chunk are the contracted links. If they fit in one forest they are solved in
   one task, else by distributed pointer doubling: each round joins the links with themselves and halves what is left.
   The number of rounds is logarithmic in the depth that remains.
3. Nodes join their top's root and offset.

Scale: links are first rebalanced by a locality key (a file, a repository). It only makes step 2 small; the result
doesn't depend on it, so a key that holds a third of all rows may be split at will, and Spark does so (rebalance).
No task holds more than `rows_per_forest` links, whatever the shape of the trees.

Defined cases: null ids are no nodes; a null parent makes a root; a parent that doesn't exist makes its child a root;
a node that is its own parent is a circle of one; exact copies and older states are dropped before (see `latest`);
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources.tables import clean_path, latest, materialise, table

ROWS_PER_FOREST = 250_000


class WeightedForest:
    """Disjoint sets over n nodes, parent -1 at a top; `offset` is the weight of each link.

    find() compresses all paths at once: every round doubles the links and adds up offsets and minima. Nodes are
    numbered in the order of their ids, so that the least number is the least id.
    """

    def __init__(self, parent: np.ndarray, offset: np.ndarray, least: np.ndarray):
        n = len(parent)
        own = np.arange(n)
        self.top, self.offset, self.least = np.where(parent < 0, own, parent), np.where(parent < 0, 0, offset), least.copy()
        at_top = parent < 0
        self.circle = np.zeros(n, bool)
        self.on_circle = np.zeros(n, bool)
        while True:
            open_ = ~at_top[self.top]
            if not open_.any():
                break
            before = int(open_.sum())
            self._double(at_top)
            if int((~at_top[self.top]).sum()) == before:  # a round that reaches no top: what is left runs in circles
                self.circle = ~at_top[self.top]
                self._circles()
                break

    def _double(self, at_top: np.ndarray) -> None:
        go = ~at_top
        self.least = np.where(go, np.minimum(self.least, self.least[self.top]), self.least)
        self.offset = np.where(go, self.offset + self.offset[self.top], self.offset)
        self.top = np.where(go, self.top[self.top], self.top)

    def _circles(self) -> None:
        c = np.flatnonzero(self.circle)
        jump, least = self.top, self.least
        image = np.unique(jump[c])
        while True:  # the image of ever longer jumps shrinks to the circles themselves
            least = least.copy()
            least[c] = np.minimum(least[c], least[jump[c]])
            nxt = jump.copy()
            nxt[c] = jump[jump[c]]
            jump = nxt
            smaller = np.unique(jump[c])
            if len(smaller) == len(image) and (least[smaller] == least[jump[smaller]]).all():
                break
            image = smaller
        self.on_circle[image] = True
        self.least[c], self.top[c] = least[jump[c]], jump[c]


def _paths(parent: np.ndarray, ids: np.ndarray, circle: np.ndarray, seg: list | None = None) -> list:
    """From each node's top down to the node; null in circles. Nodes are taken level by level."""
    out: list = [None] * len(parent)
    for start in range(len(parent)):
        chain, x = [], start
        while x >= 0 and out[x] is None and not circle[x]:
            chain.append(x)
            x = parent[x]
        for y in reversed(chain):
            p = parent[y]
            out[y] = (out[p] if p >= 0 else []) + ((seg[y] if seg is not None else None) or []) + [ids[y]]
    return out


LOCAL = "node string, parent string, top string, offset long, least string, outer string, circle boolean, path array<string>"


def _local(with_paths: bool, rows: int):
    schema = pa.schema([("node", pa.string()), ("parent", pa.string()), ("top", pa.string()), ("offset", pa.int64()), ("least", pa.string()), ("outer", pa.string()), ("circle", pa.bool_()), ("path", pa.list_(pa.string()))])

    def solve(t: pa.Table) -> pa.RecordBatch:
        node, up = t.column("node").to_numpy().astype(object), t.column("parent").to_numpy().astype(object)
        order = np.argsort(node, kind="stable")
        node, up = node[order], up[order]
        index = {x: i for i, x in enumerate(node)}
        parent = np.fromiter((index.get(x, -1) if x is not None else -1 for x in up), np.int64, len(up))
        f = WeightedForest(parent, np.ones(len(node), np.int64), np.arange(len(node)))
        top = np.where(f.circle, f.least, f.top)
        outer = np.where(f.circle, None, up[f.top]) if len(node) else up
        keep = np.array([x is not None for x in outer], bool)
        # Only a chain that goes on elsewhere can end in a circle there; the others need no least id.
        least = np.where(keep, node[f.least], None) if len(node) else node
        path = _paths(parent, node, f.circle) if with_paths else [None] * len(node)
        return pa.RecordBatch.from_arrays([pa.array(node, pa.string()), pa.array(up, pa.string()), pa.array(node[top], pa.string()), pa.array(f.offset), pa.array(least, pa.string()), pa.array(outer, pa.string()), pa.array(f.circle), pa.array(path, pa.list_(pa.string()))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= rows:
                yield solve(pa.Table.from_batches(held))
                held = []
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _one_task(links: DataFrame, with_paths: bool) -> DataFrame:
    """The contracted links (node, up, offset, least, seg) as one weighted forest."""
    schema = pa.schema([("top", pa.string()), ("root", pa.string()), ("up_offset", pa.int64()), ("up_circle", pa.bool_()), ("up_path", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        node, up, low = (t.column(c).to_numpy().astype(object) for c in ("node", "up", "least"))
        ids = np.array(sorted({*node, *(x for x in up if x is not None), *low}), dtype=object)
        index = {x: i for i, x in enumerate(ids)}
        parent, offset, least = np.full(len(ids), -1), np.zeros(len(ids), np.int64), np.arange(len(ids))
        seg: list = [None] * len(ids)
        at = np.fromiter((index[x] for x in node), np.int64, len(node))
        parent[at] = [index[x] if x is not None else -1 for x in up]
        offset[at] = t.column("offset").to_numpy()
        least[at] = [index[x] for x in low]
        if with_paths:
            for i, s in zip(at, t.column("seg").to_pylist(), strict=True):
                seg[i] = s
        f = WeightedForest(parent, offset, least)
        # A chain's own links have the least ids of their segments; the circle's is the least of all its segments.
        root = np.where(f.circle, f.least, f.top)
        path = _paths(parent, ids, f.circle, seg) if with_paths else [None] * len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.string()), pa.array(ids[root[at]], pa.string()), pa.array(f.offset[at]), pa.array(f.circle[at]), pa.array([path[i] for i in at], pa.list_(pa.string()))], schema=schema)

    return links.repartition(1).mapInArrow(run, "top string, root string, up_offset long, up_circle boolean, up_path array<string>")


def _doubling(links: DataFrame) -> DataFrame:
    """The same, distributed: pointers double until each reaches a root, or until only circles are left."""
    x = materialise(links.select("node", F.coalesce("up", "node").alias("f"), F.col("offset").alias("d"), F.col("least").alias("m"), F.col("up").isNull().alias("done"), F.when(F.col("up").isNull(), F.array("node")).otherwise(F.concat("seg", F.array("node"))).alias("path")))

    def step(x: DataFrame) -> DataFrame:
        y = x.select(F.col("node").alias("f"), F.col("f").alias("f2"), F.col("d").alias("d2"), F.col("m").alias("m2"), F.col("done").alias("done2"), F.col("path").alias("path2"))
        go = ~F.col("x.done")
        return materialise(
            x.alias("x").join(y, "f", "left").select(
                "node",
                F.when(go, F.col("f2")).otherwise(F.col("f")).alias("f"),
                F.when(go, F.col("d") + F.col("d2")).otherwise(F.col("d")).alias("d"),
                F.when(go, F.least("m", "m2")).otherwise(F.col("m")).alias("m"),
                F.when(go, F.col("done2")).otherwise(F.col("done")).alias("done"),
                F.when(go, F.concat("path2", "path")).otherwise(F.col("path")).alias("path"),
            )
        )

    open_ = x.filter("not done").count()
    while open_:
        nxt = step(x)
        left = nxt.filter("not done").count()
        if left == open_:
            break
        x, open_ = nxt, left
    done = x.filter("done").select(F.col("node").alias("top"), F.col("f").alias("root"), F.col("d").alias("up_offset"), F.lit(False).alias("up_circle"), F.col("path").alias("up_path"))
    if not open_:
        return done
    c = x.filter("not done").withColumn("path", F.lit(None).cast("array<string>"))
    size = c.select("f").distinct().count()
    while True:
        c = step(c)
        image = c.select("f").distinct()
        smaller = image.count()
        m = c.select("node", "m")
        on = c.join(image.withColumnRenamed("f", "node"), "node", "left_semi")
        uneven = on.select("f", "m").join(m.select(F.col("node").alias("f"), F.col("m").alias("m2")), "f").filter("m <> m2").limit(1).count()
        if smaller == size and not uneven:
            break
        size = smaller
    low = c.select(F.col("node").alias("f"), F.col("m").alias("root"))
    circles = c.join(low, "f").select(F.col("node").alias("top"), "root", F.lit(-1).cast("long").alias("up_offset"), F.lit(True).alias("up_circle"), F.lit(None).cast("array<string>").alias("up_path"))
    return done.unionByName(circles)


def forest(nodes: DataFrame, with_paths: bool = False, rows_per_forest: int = ROWS_PER_FOREST) -> DataFrame:
    """(node, parent, root, depth, path) of each of `nodes` (node unique, parent, loc): depth -1 and the circle's least id
    for a node on a circle or with a chain that ends in one. path is null without `with_paths`."""
    links = nodes.filter(F.col("node").isNotNull()).select("node", "parent", "loc").hint("rebalance", "loc").select("node", "parent")
    local = materialise(links.mapInArrow(_local(with_paths, rows_per_forest), LOCAL))
    # Contracted links: each top with a parent elsewhere, and where that parent's own chain leads.
    tops = local.filter("node = top and outer is not null").select(F.col("node").alias("t"), F.col("outer").alias("p"))
    n_tops = tops.count()
    if n_tops == 0:
        return local.select("node", "parent", F.col("top").alias("root"), F.when(F.col("circle"), -1).otherwise(F.col("offset")).cast("int").alias("depth"), "path")
    ends = tops.join(local.select(F.col("node").alias("p"), F.col("top").alias("p_top"), "offset", "least", "circle", "path", F.col("outer").alias("p_outer")), "p", "left")
    # A parent that doesn't exist leaves the top a root. One that hangs on a local circle or root is final at once.
    small = n_tops <= rows_per_forest
    links2 = ends.filter("not coalesce(circle, false)").select(
        F.col("t").alias("node"),
        F.col("p_top").alias("up"),
        F.coalesce(F.col("offset") + 1, F.lit(0)).cast("long").alias("offset"),
        F.coalesce(F.least(F.col("least"), F.col("t")), F.col("t")).alias("least"),
        F.expr("case when p_top is null then null else path end").alias("seg"),
    )
    inner = ends.filter("circle").select(F.col("t").alias("top"), F.col("p_top").alias("root"), F.lit(-1).cast("long").alias("up_offset"), F.lit(True).alias("up_circle"), F.lit(None).cast("array<string>").alias("up_path"))
    # `least` of a contracted link spans its segment: from the parent's node up to that chunk's top, and the top itself.
    if small:
        seen = _one_task(links2, with_paths)
    else:
        # In the doubling every `up` must have a row; tops that are local roots get one that is done.
        have = links2.select("node")
        roots = links2.filter("up is not null").select(F.col("up").alias("node")).distinct().join(have, "node", "left_anti")
        ends_in_circle = inner.select(F.col("top").alias("node"))
        roots = roots.join(ends_in_circle, "node", "left_anti").select("node", F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("offset"), F.col("node").alias("least"), F.lit(None).cast("array<string>").alias("seg"))
        hang = ends_in_circle.select("node", F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("offset"), F.col("node").alias("least"), F.lit(None).cast("array<string>").alias("seg"))
        seen = _doubling(links2.unionByName(roots).unionByName(hang)).join(have.withColumnRenamed("node", "top"), "top", "left_semi")
    # Chains whose last top hangs on a circle inside another chunk take that circle over.
    over = inner.select(F.col("top").alias("root"), F.col("root").alias("circle_root"))
    seen = seen.join(over, "root", "left").select("top", F.coalesce("circle_root", "root").alias("root"), "up_offset", (F.col("up_circle") | F.col("circle_root").isNotNull()).alias("up_circle"), F.when(F.col("circle_root").isNull(), F.col("up_path")).alias("up_path"))
    resolved = seen.unionByName(inner)
    resolved = F.broadcast(resolved) if small and not with_paths else resolved  # at most rows_per_forest rows of three short columns
    joined = local.join(resolved, "top", "left")
    hit = F.col("root").isNotNull()
    # The path of a top without `up` in one task is the top alone; a node's path begins after its top.
    path = F.when(F.col("circle") | F.coalesce("up_circle", F.lit(False)), F.lit(None).cast("array<string>")).when(hit, F.concat("up_path", F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))))).otherwise(F.col("path"))
    return joined.select(
        "node",
        "parent",
        F.coalesce("root", "top").alias("root"),
        F.when(F.col("circle") | F.coalesce("up_circle", F.lit(False)), -1).when(hit, F.col("offset") + F.col("up_offset")).otherwise(F.col("offset")).cast("int").alias("depth"),
        (path if with_paths else F.lit(None).cast("array<string>")).alias("path"),
    )


def _nodes(symbols: DataFrame, project_nodes: DataFrame) -> DataFrame:
    """Both trees as one table of nodes: a letter before each id keeps them apart and keeps the order of ids."""
    loc = F.xxhash64(clean_path(F.col("file_path")))
    s = latest(symbols.withColumn("loc", loc), "id", "indexed_at", ["id", "indexed_at", "parent", "loc"])
    repo = F.xxhash64(F.substring_index("path", "/", 2))
    n = latest(project_nodes.withColumn("loc", repo), "id", "updated_at", ["id", "updated_at", "parent_id", "loc"])
    return s.select(F.concat(F.lit("s"), "id").alias("node"), F.concat(F.lit("s"), "parent").alias("parent"), "loc").unionByName(n.select(F.concat(F.lit("n"), "id").alias("node"), F.concat(F.lit("n"), "parent_id").alias("parent"), "loc"))


def _named(df: DataFrame) -> list:
    return [F.when(df.node.startswith("s"), F.lit("symbols")).otherwise(F.lit("project_nodes")).alias("tree"), F.substring(df.node, 2, 1 << 30).alias("node_id"), F.substring(df.root, 2, 1 << 30).alias("root_id"), df.depth]


def hierarchy(symbols: DataFrame, project_nodes: DataFrame, with_paths: bool = False) -> DataFrame:
    return forest(_nodes(symbols, project_nodes), with_paths)


def p4_found(spark, sf_dir: str) -> DataFrame:
    h = hierarchy(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "project_nodes")).filter("parent is not null")
    return h.select(*_named(h))


def p4_paths(spark, sf_dir: str) -> DataFrame:
    """Every node that isn't in or under a circle, with the ids from its root down to it."""
    h = hierarchy(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "project_nodes"), True).filter("depth >= 0")
    return h.select(*_named(h), F.array_join(F.transform("path", lambda x: F.substring(x, 2, 1 << 30)), "|").alias("path"))


def p4_descendants(spark, sf_dir: str) -> DataFrame:
    """(tree, node_id, descendant_id, distance): all descendants of every node, one row for each."""
    h = hierarchy(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "project_nodes"), True).filter("depth > 0")
    d = h.select("node", "depth", F.posexplode("path").alias("level", "a")).filter("a <> node")
    return d.select(F.when(d.node.startswith("s"), F.lit("symbols")).otherwise(F.lit("project_nodes")).alias("tree"), F.substring("a", 2, 1 << 30).alias("node_id"), F.substring("node", 2, 1 << 30).alias("descendant_id"), (F.col("depth") - F.col("level")).cast("int").alias("distance"))


def p4_circles(spark, sf_dir: str) -> DataFrame:
    """Circles by their least id, with the number of nodes on them or leading into them."""
    h = p4_found(spark, sf_dir).filter("depth = -1")
    return h.groupBy("tree", F.col("root_id").alias("circle_id")).agg(F.count("*").alias("nodes"))


_V = """WITH RECURSIVE n AS (SELECT 'symbols' AS tree, id, parent FROM (SELECT id, parent, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, parent DESC NULLS LAST) AS rn FROM symbols WHERE id IS NOT NULL) WHERE rn = 1
UNION ALL SELECT 'project_nodes', id, parent_id FROM (SELECT id, parent_id, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, parent_id DESC NULLS LAST) AS rn FROM project_nodes WHERE id IS NOT NULL) WHERE rn = 1),
up AS (SELECT n.tree, n.id, n.parent, p.id AS up FROM n LEFT JOIN n p ON p.tree = n.tree AND p.id = n.parent),
walk AS (SELECT tree, id AS node_id, id AS cur, up AS nxt, 0 AS depth, [id] AS seen FROM up
UNION ALL SELECT w.tree, w.node_id, u.id, u.up, w.depth + 1, list_prepend(u.id, w.seen) FROM walk w JOIN up u ON u.tree = w.tree AND u.id = w.nxt WHERE NOT list_contains(w.seen, w.nxt)),
ends AS (SELECT tree, node_id, cur AS root_id, depth, seen FROM walk WHERE nxt IS NULL
UNION ALL SELECT tree, node_id, list_min(seen[1:list_position(seen, nxt)]), -1, NULL FROM walk WHERE list_contains(seen, nxt))
"""
QUERIES = {"p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants, "p4_circles": p4_circles}
ORACLES = {
    "p4_found": _V + "SELECT e.tree, e.node_id, e.root_id, e.depth::INT AS depth FROM ends e JOIN n ON n.tree = e.tree AND n.id = e.node_id WHERE n.parent IS NOT NULL",
    "p4_paths": _V + "SELECT tree, node_id, root_id, depth::INT AS depth, array_to_string(seen, '|') AS path FROM ends WHERE depth >= 0",
    "p4_descendants": _V + "SELECT w.tree, w.cur AS node_id, w.node_id AS descendant_id, w.depth::INT AS distance FROM walk w JOIN ends e ON e.tree = w.tree AND e.node_id = w.node_id WHERE e.depth > 0 AND w.depth > 0",
    "p4_circles": _V + "SELECT e.tree, e.root_id AS circle_id, count(*) AS nodes FROM ends e JOIN n ON n.tree = e.tree AND n.id = e.node_id WHERE n.parent IS NOT NULL AND e.depth = -1 GROUP BY 1, 2",
}
