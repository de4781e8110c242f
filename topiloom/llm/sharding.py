"""K-d tree sharding: leaves of near equal bytes.

Rows are points over numeric metadata: size, lines and words on log scales, and the
shares of characters that are digits, capitals or outside ASCII.  All of them are facts
of the text alone, so copies of a text are one point and are never parted by a split (their
sources may differ, so a source is no dimension).  A node that stands for n shards is
split into n // 2 and the rest along the dimension in which its rows lie widest, at the
weighted median: the place that divides its bytes in proportion.  Width is measured from
the median to the 5th and the 95th percentile, and the shorter way counts, as a share of
the same of the whole table: so neither a scale nor a few odd rows decide, and a dimension
in which half of the rows are equal is not split through them.  Splitting ends when a leaf stands for one
shard, and so holds the target bytes.

Medians are found by refinement: quantiles propose cuts, one aggregation weighs the
intervals between them, and the interval that holds the median is looked at next.
All nodes of a level are refined together.  Each step is a partial aggregation over
a narrow stored table; no row moves, and the driver sees some dozens of numbers per
node.  The tree itself is a few numbers per shard, sent along with the tasks.

Rows that lie on the median are told apart by a hash of their text, so equal texts
stay together, as far as that costs at most ``SLACK`` of a shard; larger groups are
cut by id.

Defined cases: a null text has no bytes and counts as empty; null ids come first;
repeated rows lie on one side; fewer rows than shards leave shards empty; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topiloom.llm.common import cut, ranked

SHARDS = 16
#: A cut may miss the median by this share of a shard's bytes.
SLACK = 0.005
#: Percentiles by which a dimension's width is measured.
WIDTH = (0.05, 0.5, 0.95)
DIMENSIONS = ("log_size", "log_lines", "log_words", "digits", "capitals", "non_ascii")
TIES = ("_text", "_id")
_CUTS = 32
_LEAST = -(1 << 63)


@dataclasses.dataclass
class Node:
    """``leaves`` shards from ``first`` on.  Inner nodes have ``keys``: the dimension
    and its tie-breakers, with the values up to which rows go left."""

    first: int
    leaves: int
    keys: list[tuple[str, int]] = dataclasses.field(default_factory=list)
    low: Node | None = None
    high: Node | None = None

    def place(self, columns: dict[str, np.ndarray], rows: np.ndarray, out: np.ndarray) -> None:
        """Writes the first shard of the deepest node that each of ``rows`` comes to."""
        if self.low is None or not len(rows):
            out[rows] = self.first
            return
        goes_low = np.ones(len(rows), dtype=bool)  # rows that are equal in all keys
        for name, value in reversed(self.keys):
            x = columns[name][rows]
            goes_low = (x < value) | ((x == value) & goes_low)
        self.low.place(columns, rows[goes_low], out)
        self.high.place(columns, rows[~goes_low], out)


@dataclasses.dataclass
class _Search:
    """Where a node's median still may lie."""

    node: Node
    columns: list[str]  # the dimension, then its tie-breakers
    want: float  # bytes that should go left
    slack: float
    below: float = 0.0  # bytes known to go left
    fixed: list[int] = dataclasses.field(default_factory=list)
    low: int = _LEAST
    high: int = (1 << 63) - 1
    done: bool = False

    @property
    def column(self) -> str:
        return self.columns[len(self.fixed)]

    def active(self, columns: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
        x = columns[self.column]
        out = (at == self.node.first) & (x >= self.low) & (x <= self.high)
        for name, v in zip(self.columns, self.fixed):
            out &= columns[name] == v
        return np.flatnonzero(out)

    def end(self, value: int) -> None:
        self.node.keys = [*zip(self.columns, self.fixed), (self.column, value)]
        self.done = True


def _each(rows: DataFrame, root: Node, names: list[str], what: Callable, schema: str) -> DataFrame:
    """``what`` (columns, place in the tree, batch) for every batch of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(batch.schema.get_field_index(n)).to_numpy() for n in names}
            at = np.zeros(batch.num_rows, dtype=np.int32)
            root.place(columns, np.arange(batch.num_rows), at)
            yield from what(columns, at, batch)

    return rows.mapInArrow(run, schema)


def _refine(rows: DataFrame, root: Node, names: list[str], searches: list[_Search]) -> None:
    """One step for each search: propose cuts, weigh between them, narrow down."""

    def values(columns, at, batch):
        for s in searches:
            x = columns[s.column][s.active(columns, at)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), s.node.first), pa.int32()), pa.array(x)], names=["at", "x"])

    # Quantiles are approximate, and of large values only doubles; the middle of each
    # range is a cut too, so that every step narrows it.
    shares = [i / _CUTS for i in range(1, _CUTS)]
    found = _each(rows, root, names, values, "at int, x long").groupBy("at").agg(F.percentile_approx("x", shares, 1000).alias("q"), F.min("x").alias("least"), F.max("x").alias("most"))
    quantiles = {r["at"]: r for r in found.collect()}
    cuts = {k: np.array(sorted({r["most"], (r["least"] + r["most"]) >> 1, *(v for q in r["q"] for v in (q, q - 1) if r["least"] <= v < r["most"])}), dtype=np.int64) for k, r in quantiles.items()}

    def weighed(columns, at, batch):
        for s in searches:
            active = s.active(columns, at)
            i = np.searchsorted(cuts[s.node.first], columns[s.column][active], side="left") if len(active) else active
            w = np.bincount(i, weights=columns["size"][active]).astype(np.int64)
            full = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), s.node.first), pa.int32()), pa.array(full, pa.int32()), pa.array(w[full])], names=["at", "i", "w"])

    sums = _each(rows, root, names, weighed, "at int, i int, w long").groupBy("at", "i").agg(F.sum("w").alias("w"))
    weights = {(r["at"], r["i"]): r["w"] for r in sums.collect()}
    for s in searches:
        bounds, below, least = cuts[s.node.first].tolist(), s.below, quantiles[s.node.first]["least"]
        for i, bound in enumerate(bounds):
            weight = weights.get((s.node.first, i), 0)
            if below + weight < s.want and i < len(bounds) - 1:
                below += weight
                continue
            start = least if i == 0 else bounds[i - 1] + 1
            last_key = len(s.fixed) == len(s.columns) - 1
            if weight <= s.slack or (start == bound and last_key):
                # to the nearer edge; the value below the start stands for "none of these"
                s.end(bound if below + weight - s.want <= s.want - below or start == _LEAST else start - 1)
            elif start == bound:
                s.below, s.fixed = below, [*s.fixed, bound]
                s.low, s.high = _LEAST, (1 << 63) - 1
            else:
                s.below, s.low, s.high = below, start, bound
            break


def _width(found, total, dimension: str) -> float:
    """A node's width in ``dimension``, in widths of the whole table."""
    own, whole = (min(mid - low, high - mid) for low, mid, high in (found[dimension], total[dimension]))
    return own / whole if whole else 0.0


def build(rows: DataFrame, dimensions: Sequence[str] = DIMENSIONS, ties: Sequence[str] = TIES, shards: int = SHARDS, slack: float = SLACK) -> tuple[Node, int]:
    """The tree over ``rows`` (a stored table with long columns and ``size``), and their number."""
    names = list(dict.fromkeys([*dimensions, *ties, "size"]))
    ranges = [F.percentile_approx(d, list(WIDTH), 1000).alias(d) for d in dimensions]
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"), *ranges).first()
    root = Node(0, shards)
    level = [root] if total["n"] and shards > 1 else []
    target = (total["w"] or 0) / shards
    placed_schema = "at int, w long, " + ", ".join(f"{d} long" for d in dimensions)

    def spread(columns, at, batch):
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(columns[n]) for n in ("size", *dimensions))], names=["at", "w", *dimensions])

    while level:
        spans = {r["at"]: r for r in _each(rows, root, names, spread, placed_schema).groupBy("at").agg(F.sum("w").alias("w"), *ranges).collect()}
        searches = []
        for node in level:
            if node.first not in spans:  # no rows have come here
                continue
            found = spans[node.first]
            want = found["w"] * (node.leaves // 2) / node.leaves
            widest = max(dimensions, key=lambda d: _width(found, total, d))  # noqa: B023
            searches.append(_Search(node, [widest, *ties], want, slack * target))
        while searching := [s for s in searches if not s.done]:
            _refine(rows, root, names, searching)
        level = []
        for s in searches:
            n = s.node
            n.low, n.high = Node(n.first, n.leaves // 2), Node(n.first + n.leaves // 2, n.leaves - n.leaves // 2)
            level += [x for x in (n.low, n.high) if x.leaves > 1]
    return root, total["n"]


def metadata(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, dimensions, _text, _id): what the tree sees of a document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    without = lambda what: F.length(text) - F.length(F.translate(text, what, ""))
    log = lambda x: F.round(F.log2(x + 1) * (1 << 20)).cast("long")
    share = lambda x, of: F.round(x / F.greatest(of, F.lit(1)) * (1 << 20)).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        log(F.octet_length(text)).alias("log_size"),
        log(without("\n")).alias("log_lines"),
        log(without(" ")).alias("log_words"),
        share(without("0123456789"), F.length(text)).alias("digits"),
        share(without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.length(text)).alias("capitals"),
        share(F.octet_length(text) - F.length(text), F.octet_length(text)).alias("non_ascii"),
        F.shiftright(F.xxhash64(text), 11).alias("_text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("_id"),
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``."""
    rows = cut(metadata(docs), "metadata")
    tree, n = build(rows, DIMENSIONS, TIES, shards, slack)
    names = [*DIMENSIONS, *TIES, "size"]

    def with_shard(columns, at, batch):
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "shard"])

    placed = _each(rows, tree, names, with_shard, T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType())]))
    out = ranked(placed.select("doc_id", "size", "text_crc32", "shard", *TIES), ["shard"], list(TIES), "slot", n)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
