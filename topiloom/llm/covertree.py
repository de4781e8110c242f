"""Exact near-duplicate embeddings by dual traversal of cover trees.

Vectors with one label are linked when their cosine reaches a threshold; on the unit
sphere that is a Euclidean distance of at most sqrt(2 - 2 * threshold).

The vectors of a label are dealt into blocks of bounded size, region by region: the upper
levels of a cover tree over a bounded sample give centres, every vector goes to its nearest
one, and a region's covering radius is the distance of its farthest vector.  Regions that
lie too far apart for any link never meet, so their blocks are not even sent to each other.
(Vectors in random directions have no regions; then all blocks of a label meet.)

Each block becomes a cover tree: nested levels of centres whose radii halve, where every node also knows
its covering radius, the distance to its farthest descendant.  Two trees are
traversed together.  A pair of nodes is dropped when even their nearest descendants
must lie too far apart, and taken whole when even their farthest must be linked; what
is left is opened one level, down to single vectors, which are compared by cosine in
double precision.  Both bounds leave a margin for rounding, so the result is exact.

A traversal yields numbers of links per vector and a spanning forest of its links,
never the links themselves, so a dense group costs no more rows than it has members.
Equal vectors are one node with a weight.

Defined cases: vectors that are null, empty or zero, or hold a null or non-finite
component, and vectors without a label link with nothing; vectors of different length
are not compared; repeated rows and equal ids are rows of their own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topiloom.llm.common import HOT_KEYS, cut, hot_rows, with_value
from topiloom.llm.components import components

THRESHOLD = 0.98
BLOCK = 2048
#: Far above the rounding of a distance in double precision, far below any radius.
MARGIN = 1e-6
_LEAST_RADIUS = 0.02


@dataclasses.dataclass
class Tree:
    """Levels from the root down.  ``ids[l]`` are the rows that are nodes of level l,
    ``child[l]`` gives for every node of level l + 1 its parent's place in level l, in
    ascending order, ``reach[l]`` the covering radius of each node, and ``held[l]`` the
    number of vectors under it.  A radius of 0 does not mean one vector: multiples of a
    vector are vectors of their own with the same unit vector."""

    points: np.ndarray  # unit vectors
    ids: list[np.ndarray]
    parent: list[np.ndarray]
    reach: list[np.ndarray]
    held: list[np.ndarray]

    def children(self, level: int, node: int) -> slice:
        p = self.parent[level]
        return slice(int(np.searchsorted(p, node)), int(np.searchsorted(p, node, side="right")))


def build(points: np.ndarray) -> Tree:
    """A cover tree.  Each level's centres are picked greedily, in order, so that they lie
    more than its radius apart and all points of their parent are covered; a centre stays
    a centre of all levels below.  The last level holds every point."""
    ids, parents = [np.array([0])], []
    members = [np.arange(len(points))]  # of each node of the last level
    radius = 1.0
    while any(len(m) > 1 for m in members):
        level_ids, level_parent, level_members = [], [], []
        for node, own in enumerate(members):
            rest = own
            if radius < _LEAST_RADIUS:
                for i in own:
                    level_ids.append(i)
                    level_parent.append(node)
                    level_members.append(np.array([i]))
                continue
            centre = int(ids[-1][node])
            while len(rest):
                d = _distances(points[rest], points[centre : centre + 1])[:, 0]
                near = d <= radius
                near[rest == centre] = True
                level_ids.append(centre)
                level_parent.append(node)
                level_members.append(rest[near])
                rest = rest[~near]
                if len(rest):
                    centre = int(rest[0])
                if len(own) > 64 and len(level_members) and not near.sum() > 1 and len(rest) > 64:
                    # sparse: see at once which of the rest have no neighbour at all
                    alone = _lonely(points[rest], radius)
                    for i in rest[alone]:
                        level_ids.append(int(i))
                        level_parent.append(node)
                        level_members.append(np.array([i]))
                    rest = rest[~alone]
                    if len(rest):
                        centre = int(rest[0])
        ids.append(np.array(level_ids))
        parents.append(np.array(level_parent))
        members = level_members
        radius /= 2
    tree = Tree(points, ids, parents, [np.zeros(len(i)) for i in ids], [np.ones(len(i), dtype=np.int64) for i in ids])
    # covering radii: exact, from the lowest level up
    owner = np.arange(len(ids[-1]))
    for level in range(len(ids) - 2, -1, -1):
        owner = parents[level][owner]
        d = np.sqrt(np.maximum(0.0, ((points[ids[level][owner]] - points[ids[-1]]) ** 2).sum(axis=1)))
        np.maximum.at(tree.reach[level], owner, d)
        tree.held[level] = np.bincount(owner, minlength=len(ids[level]))
    return tree


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _lonely(points: np.ndarray, radius: float) -> np.ndarray:
    """Which points have no other within ``radius``."""
    out = np.empty(len(points), dtype=bool)
    for i in range(0, len(points), 512):
        d = _distances(points[i : i + 512], points)
        out[i : i + 512] = (d <= radius).sum(axis=1) <= 1
    return out


class Links:
    """Numbers of links, weighted by copies, and a spanning forest of them."""

    def __init__(self, n: int):
        self.count = np.zeros(n, dtype=np.int64)
        self.root = list(range(n))
        self.forest: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            self.forest.append((i, j))


def traverse(x: Tree, y: Tree | None, raw: tuple[np.ndarray, np.ndarray | None], weight: tuple[np.ndarray, np.ndarray | None], threshold: float) -> Links:
    """All links between ``x`` and ``y``, or inside ``x`` where ``y`` is None.

    Vectors of ``y`` are numbered after those of ``x``.
    """
    own = y is None
    other = x if own else y
    raw_y, weight_y = (raw[0], weight[0]) if own else (raw[1], weight[1])
    shift = 0 if own else len(x.points)
    links = Links(len(x.points) + (0 if own else len(other.points)))
    limit = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    norm_x, norm_y = np.linalg.norm(raw[0], axis=1), np.linalg.norm(raw_y, axis=1)
    lowest = (len(x.ids) - 1, len(other.ids) - 1)
    stack = [(0, 0, 0, 0)]  # level and node on both sides
    while stack:
        lx, nx, ly, ny = stack.pop()
        if (lx, ly) == lowest:
            _compare(links, np.array([x.ids[lx][nx]]), np.array([other.ids[ly][ny]]), raw[0], raw_y, norm_x, norm_y, weight[0], weight_y, threshold, own, shift)
            continue
        cx = x.children(lx, nx) if lx < lowest[0] else slice(nx, nx + 1)
        cy = other.children(ly, ny) if ly < lowest[1] else slice(ny, ny + 1)
        kx, ky = min(lx + 1, lowest[0]), min(ly + 1, lowest[1])
        rx, ry = x.reach[kx][cx], other.reach[ky][cy]
        hx, hy = x.held[kx][cx], other.held[ky][cy]
        ix, iy = x.ids[kx][cx], other.ids[ky][cy]
        for a in range(0, len(ix), 1024):
            d = _distances(x.points[ix[a : a + 1024]], other.points[iy])
            open_ = d - rx[a : a + 1024, None] - ry[None, :] <= limit + MARGIN
            if own and lx == ly and nx == ny:
                open_ &= np.arange(a, a + len(d))[:, None] <= np.arange(len(iy))[None, :]
            p, q = np.nonzero(open_)
            single = (hx[a + p] == 1) & (hy[q] == 1)
            # nodes that are single vectors on both sides need not be opened further
            if single.any():
                _pairs(links, ix[a + p[single]], iy[q[single]], raw[0], raw_y, norm_x, norm_y, weight[0], weight_y, threshold, own, shift)
            for i, j in zip(p[~single].tolist(), q[~single].tolist()):
                whole = d[i, j] + rx[a + i] + ry[j] <= limit - MARGIN
                if whole:
                    _whole(links, _below(x, kx, cx.start + a + i), _below(other, ky, cy.start + j), weight[0], weight_y, own, shift)
                else:
                    stack.append((kx, cx.start + a + i, ky, cy.start + j))
    return links


def _below(tree: Tree, level: int, node: int) -> np.ndarray:
    """The vectors under a node."""
    first, last = node, node + 1
    for l in range(level, len(tree.ids) - 1):
        first, last = int(np.searchsorted(tree.parent[l], first)), int(np.searchsorted(tree.parent[l], last - 1, side="right"))
    return tree.ids[-1][first:last]


def _whole(links: Links, a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, own: bool, shift: int) -> None:
    """Every vector of ``a`` is linked with every one of ``b``."""
    same = own and a[0] == b[0] and len(a) == len(b) and np.array_equal(a, b)
    if same:
        links.count[a] += wa[a].sum() - wa[a]
    else:
        links.count[a] += wb[b].sum()
        links.count[b + shift] += wa[a].sum()
    for i in a.tolist():
        links.join(i, int(b[0]) + shift)
    for j in b.tolist():
        links.join(int(a[0]), j + shift)


def _pairs(links: Links, a, b, raw_a, raw_b, norm_a, norm_b, wa, wb, threshold: float, own: bool, shift: int) -> None:
    if own:
        keep = a != b
        a, b = a[keep], b[keep]
    for s in range(0, len(a), 4096):
        i, j = a[s : s + 4096], b[s : s + 4096]
        cosine = np.einsum("ij,ij->i", raw_a[i], raw_b[j]) / (norm_a[i] * norm_b[j])
        linked = cosine >= threshold
        i, j = i[linked], j[linked]
        np.add.at(links.count, i, wb[j])
        np.add.at(links.count, j + shift, wa[i])
        for u, v in zip(i.tolist(), j.tolist()):
            links.join(u, v + shift)


def _compare(links: Links, a, b, *rest) -> None:
    _pairs(links, a, b, *rest)


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("_usable", usable)
    # copies are one node
    named = F.when(F.col("_usable"), F.md5(F.concat_ws("|", F.col("label").cast("string"), F.to_json("vector")).cast("binary")))
    rows = rows.select("vec_id", "label", "vector", named.alias("node"))
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"))
    nodes = cut(nodes.withColumn("dim", F.size("vector")), "nodes")
    dealt = _dealt(nodes, threshold, block)
    # every pair of near blocks of a label meets once; a block is sent once for each of them
    met = dealt.withColumn("c", F.explode(F.flatten(F.transform("partners", lambda p: F.sequence(p["first"], p["first"] + p["blocks"] - 1)))))
    met = met.select("label", "dim", F.least("b", "c").alias("left"), F.greatest("b", "c").alias("right"), (F.col("b") > F.col("c")).alias("second"), "node", "weight", "vector")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        return _meet(rows, threshold)

    found = met.groupBy("label", "dim", "left", "right").applyInArrow(run, "node string, n long, mate string")
    found = cut(found, "links")
    counts = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    groups = components(found.where("mate IS NOT NULL").select(F.col("node").alias("u"), F.col("mate").alias("v")))
    owned = groups.join(nodes.select(F.col("node").alias("_node"), "vec_id"), F.col("node") == F.col("_node")).select("node", "root", "vec_id")
    least = owned.groupBy(F.col("root").alias("_key")).agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("_n"))
    n = rows.count()
    grouped = with_value(owned.select("node", "root"), "root", least.drop("_n"), least.where(F.col("_n") > hot_rows(n)).drop("_n")).select(F.col("node").alias("_g"), "least")
    told = nodes.join(grouped, F.col("node") == F.col("_g"), "left").join(counts.select(F.col("node").alias("_c"), "n"), F.col("node") == F.col("_c"), "left")
    told = cut(told.select(F.col("node").alias("_key"), F.coalesce("least", "vec_id").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("links"), "weight"), "told")
    values = told.drop("weight")
    linked = with_value(rows.where("node IS NOT NULL").select("vec_id", "node"), "node", values, told.where(F.col("weight") > hot_rows(n)).drop("weight"))
    alone = rows.where("node IS NULL").select("vec_id", "node", F.col("vec_id").alias("component"), F.lit(0).cast("long").alias("links"))
    component = F.coalesce("component", "vec_id")
    return linked.unionByName(alone).select("vec_id", F.col("links").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: Labels of more than a block that are parted into regions, the largest first; the others'
#: blocks all meet.  Regions of a label, and what is sampled for their centres, in all.
LARGE_LABELS, REGIONS, SAMPLE_ROWS, SAMPLE_BYTES = 32, 64, 512, 16 << 20


def _dealt(nodes: DataFrame, threshold: float, block: int) -> DataFrame:
    """label, dim, b, partners, node, weight, vector: each vector's block and the runs of
    blocks (first, blocks) of its label that may hold a link of its."""
    spark = nodes.sparkSession
    sizes = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    many = cut(sizes, "sizes")
    whole = F.ceil(F.col("n") / block).cast("int")
    plan = many.select(F.col("label").alias("_label"), F.col("dim").alias("_dim"), F.lit(0).alias("_region"), F.lit(0).alias("first"), whole.alias("blocks"), F.array(F.struct(F.lit(0).alias("first"), whole.alias("blocks"))).alias("partners"))
    centres = _centres(nodes, many)
    regions = nodes.withColumn("region", F.lit(0))
    if centres:
        placed = cut(_nearest(nodes, centres), "regions")
        found = placed.groupBy("label", "dim", "region").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).where("radius IS NOT NULL").collect()
        special = spark.createDataFrame(_partners(found, centres, threshold, block), T.StructType([T.StructField("_label", nodes.schema["label"].dataType), *T._parse_datatype_string("_dim int, _region int, first int, blocks int, partners array<struct<first:int,blocks:int>>").fields]))
        plan = plan.join(F.broadcast(special.select("_label", "_dim").distinct()), ["_label", "_dim"], "left_anti").unionByName(special)
        regions = placed.drop("d")
    plan = cut(plan, "plan")
    plan = F.broadcast(plan) if plan.count() <= HOT_KEYS else plan
    on = (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")) & (F.col("region") == F.col("_region"))
    named = regions.join(plan, on, "left")
    one = F.array(F.struct(F.lit(0).alias("first"), F.lit(1).alias("blocks")))
    b = F.coalesce(F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks")), F.lit(0)).cast("int")
    return named.select("label", "dim", b.alias("b"), F.coalesce("partners", one).alias("partners"), "node", "weight", "vector")


def _centres(nodes: DataFrame, many: DataFrame) -> dict[tuple, np.ndarray]:
    """Unit vectors by (label, dim): a level of the cover tree over a sample of the label."""
    large = many.orderBy(F.desc("n"), "label", "dim").limit(LARGE_LABELS).collect()
    if not large:
        return {}
    named = nodes.sparkSession.createDataFrame([(r["label"], r["dim"], r["n"]) for r in large], T.StructType([T.StructField("_label", nodes.schema["label"].dataType), T.StructField("_dim", T.IntegerType()), T.StructField("_n", T.LongType())]))
    bound = max(2, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(r["dim"] for r in large) * len(large))))
    h = F.pmod(F.xxhash64("node", F.lit("centre")), F.lit(1 << 30))
    rows = nodes.join(F.broadcast(named), (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")))
    rows = rows.where(h < (1.5 * bound + 8) / F.col("_n") * (1 << 30)).select("label", "dim", "node", "vector", h.alias("h"))
    rank = F.row_number().over(Window.partitionBy("label", "dim").orderBy("h", "node"))
    drawn: dict[tuple, list] = {}
    for r in rows.withColumn("rank", rank).where(F.col("rank") <= bound).orderBy("rank").collect():
        drawn.setdefault((r["label"], r["dim"]), []).append(r["vector"])
    out = {}
    for key, vectors in drawn.items():
        x = np.array(vectors, dtype=np.float64)
        tree = build(x / np.linalg.norm(x, axis=1, keepdims=True))
        out[key] = tree.points[max((ids for ids in tree.ids if len(ids) <= REGIONS), key=len)]
    return {key: c for key, c in out.items() if len(c) > 1}


def _nearest(nodes: DataFrame, centres: dict[tuple, np.ndarray]) -> DataFrame:
    """``nodes`` with the region of each vector and its distance ``d`` to the centre; 0 and
    null for labels without regions."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)
    columns = nodes.columns

    def run(batches):
        for batch in batches:
            labels, dims = batch.column(columns.index("label")).to_pylist(), batch.column(columns.index("dim")).to_pylist()
            by: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(labels, dims)):
                if key in shared.value:
                    by.setdefault(key, []).append(i)
            region, d = np.zeros(batch.num_rows, dtype=np.int32), np.full(batch.num_rows, np.nan)
            for key, own in by.items():
                x = _vectors(batch.column(columns.index("vector")).take(pa.array(own)))
                apart = _distances(x / np.linalg.norm(x, axis=1, keepdims=True), shared.value[key])
                region[own] = apart.argmin(axis=1)
                d[own] = apart.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(d, from_pandas=True)], names=[*columns, "region", "d"])

    return nodes.mapInArrow(run, T.StructType([*nodes.schema.fields, T.StructField("region", T.IntegerType()), T.StructField("d", T.DoubleType())]))


def _partners(found: list, centres: dict[tuple, np.ndarray], threshold: float, block: int) -> list[tuple]:
    """(label, dim, region, first, blocks, partners) of every region that has vectors."""
    limit = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    by: dict[tuple, list] = {}
    for r in sorted(found, key=lambda r: r["region"]):
        by.setdefault((r["label"], r["dim"]), []).append(r)
    out = []
    for key, own in by.items():
        blocks = np.array([-(-r["n"] // block) for r in own])
        first = np.cumsum(blocks) - blocks
        radius = np.array([r["radius"] for r in own])
        at = centres[key][[r["region"] for r in own]]
        near = _distances(at, at) - radius[:, None] - radius[None, :] <= limit + MARGIN
        for i, r in enumerate(own):
            out.append((*key, r["region"], int(first[i]), int(blocks[i]), [(int(first[j]), int(blocks[j])) for j in np.flatnonzero(near[i] | (np.arange(len(own)) == i))]))
    return out


def _meet(rows: pa.Table, threshold: float) -> pa.Table:
    """Links of a pair of blocks: rows with a number of links, then rows of the forest."""
    second = rows["second"].to_numpy(zero_copy_only=False).astype(bool)
    names, raw, weight = np.array(rows["node"].to_pylist(), dtype=object), _vectors(rows["vector"]), rows["weight"].to_numpy()
    own = rows["left"][0].as_py() == rows["right"][0].as_py()
    parts = [np.arange(len(names))] if own else [np.flatnonzero(~second), np.flatnonzero(second)]
    parts = [p[np.argsort(names[p])] for p in parts]  # the same tree wherever a block is built
    if any(not len(p) for p in parts):
        return _links_table([], [], [])
    trees = [build(raw[p] / np.linalg.norm(raw[p], axis=1, keepdims=True)) for p in parts]
    order = np.concatenate(parts)
    a, b = parts[0], parts[-1]
    links = traverse(trees[0], None if own else trees[1], (raw[a], None if own else raw[b]), (weight[a], None if own else weight[b]), threshold)
    told = np.flatnonzero(links.count)
    node = [names[order[i]] for i in told] + [names[order[i]] for i, _ in links.forest]
    return _links_table(node, links.count[told].tolist() + [0] * len(links.forest), [None] * len(told) + [names[order[j]] for _, j in links.forest])


def _links_table(node: list, n: list, mate: list) -> pa.Table:
    return pa.table({"node": pa.array(node, pa.string()), "n": pa.array(n, pa.int64()), "mate": pa.array(mate, pa.string())})
