"""Benchmark decontamination by winnowed fingerprints.

A *window* is ``window`` consecutive words of a benchmark item; an item with
fewer words is one window.  Every document word inside an occurrence of a window
is *hit*.

Winnowing makes the candidates: of every ``w`` consecutive k-gram hashes the
least are kept, on both sides by the same rule.  With ``k + w - 1 = window`` any
shared span of a window's length keeps a common fingerprint, so none is missed.
Each item length below ``window`` gets a (k, w) of its own, so short items are
found with the same guarantee.  Common fingerprints are joined; every joined pair
is then extended word by word, on the words themselves, to the longest equal
span, which must be at least one window long.

The benchmark is the bounded side.  It is dealt into blocks of at most
``block_bytes`` and each block is broadcast; the documents stream past it without
any shuffle, so neither a hot passage nor a hot document moves.  A benchmark of
many blocks takes one pass per block, with the hits so far carried along.

Defined cases: null or empty texts have no words and no hits; null item ids match
but are not listed; items of equal id count once; repeated documents each get
their row; an empty benchmark leaves all documents clean; an empty table gives no
rows; other columns are kept as they are, whatever they are called.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiloom.llm import bytewise as bw
from topiloom.llm.common import as_row, cut, field, from_row

WINDOW = 10
BLOCK_BYTES = 16 << 20


def gram_and_run(span: int) -> tuple[int, int]:
    """k and w with k + w - 1 = span."""
    k = (span + 1) // 2
    return k, span - k + 1


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Whether each hash is the least of some ``w`` consecutive ones (of all, if fewer).

    Ties all count, so equal runs keep equal fingerprints wherever they stand.
    """
    n = len(hashes)
    if n <= w:
        return hashes == hashes.min() if n else np.zeros(0, dtype=bool)
    least = hashes[: n - w + 1].copy()
    for j in range(1, w):
        np.minimum(least, hashes[j : j + n - w + 1], out=least)
    keep = np.zeros(n, dtype=bool)
    for j in range(w):
        keep[j : j + n - w + 1] |= hashes[j : j + n - w + 1] == least
    return keep


class Index:
    """Winnowed fingerprints of one block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.window = window
        self.ids = [i for i, _ in items]
        self.spans: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        column = pa.array([t for _, t in items], pa.large_string())
        hashes, owner, texts = [], [], []
        for row, data, offsets in bw.slices(column):
            starts, ends, first = bw.words(data, offsets, bw.ALNUM)
            low = bw.LOWER[data].tobytes()
            h = bw.word_hashes(data, starts, ends)
            for k in range(len(offsets) - 1):
                a, b = first[k], first[k + 1]
                hashes.append(h[a:b])
                texts.append([low[s:e] for s, e in zip(starts[a:b], ends[a:b])])
                owner.append(row + k)
        self.words = texts
        by_span: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            if len(h):
                by_span.setdefault(min(len(h), window), []).append(i)
        for span, members in by_span.items():
            k, w = gram_and_run(span)
            prints, where = [], []
            for i in members:
                g = bw.grams(hashes[i], k)
                p = np.flatnonzero(winnow(g, w))
                prints.append(g[p])
                where.append(np.stack([np.full(len(p), i), p], axis=1))
            allp, allw = np.concatenate(prints), np.concatenate(where)
            order = np.argsort(allp, kind="stable")
            self.spans[span] = (k, w, allp[order], allw[order])

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int]]]]:
        """Words before each text, and by text its (start word, end word, item) spans."""
        starts, ends, first = bw.words(data, offsets, bw.ALNUM)
        hashes = bw.word_hashes(data, starts, ends)
        low = bw.LOWER[data]
        found: dict[int, list[tuple[int, int, int]]] = {}
        word = lambda j: low[starts[j] : ends[j]].tobytes()
        for span, (k, w, prints, where) in self.spans.items():
            g = bw.grams(hashes, k)
            at = np.flatnonzero(_winnow_texts(g, first, k, w))
            left = np.searchsorted(prints, g[at], side="left")
            right = np.searchsorted(prints, g[at], side="right")
            joined = np.flatnonzero(right > left)
            done: dict[tuple[int, int], int] = {}  # (item, diagonal): end of the span already extended
            for j in joined:
                p = int(at[j])
                text = int(np.searchsorted(first, p, side="right")) - 1
                lo, hi = int(first[text]), int(first[text + 1])
                for item, q in where[left[j] : right[j]].tolist():
                    if done.get((item, p - q), -1) > p:
                        continue
                    target = self.words[item]
                    a, c = p, q
                    while a > lo and c > 0 and word(a - 1) == target[c - 1]:
                        a, c = a - 1, c - 1
                    b, d = p, q
                    while b < hi and d < len(target) and word(b) == target[d]:
                        b, d = b + 1, d + 1
                    if b > p:
                        done[item, p - q] = b
                        if b - a >= span:
                            found.setdefault(text, []).append((a - lo, b - lo, item))
        return first, found


def _winnow_texts(g: np.ndarray, first: np.ndarray, k: int, w: int) -> np.ndarray:
    """Winnowing of all texts of a slice at once, without grams that span two texts.

    A window inside one text keeps its least gram whatever its neighbours keep,
    so the guarantee holds; grams at borders may be kept besides.
    """
    keep = winnow(g, w)
    at = np.flatnonzero(keep)
    keep[at[~bw.same_text(at, first, k)]] = False
    return keep


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[str | None, str]]]:
    """The benchmark in blocks, each small enough to broadcast.  One block at a time is on the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    n = -(-total // block_bytes)
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r.i, r.t) for r in part.distinct().orderBy("i", "t").collect()]


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (all columns of ``docs``), n_words, spans (merged [start, end) in words) and items (ids, sorted)."""
    out = as_row(docs).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<start:long,end:long>>"), "items": F.array().cast("array<string>")})
    first_block = True
    for items in _blocks(benchmark, block_bytes):
        if not first_block:
            out = cut(out, "spans")
        out = _pass(out, items, window)
        first_block = False
    return out if not first_block else _pass(out, [], window)


_INDEX: dict[str, Index] = {}


def _index(name: str, shared: Broadcast, window: int) -> Index:
    """A worker builds the index of a block once, whatever the number of its tasks."""
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = Index(shared.value, window)
    return _INDEX[name]


def _pass(docs: DataFrame, items: list[tuple[str | None, str]], window: int) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    text_at = docs.schema["row"].dataType.names.index("text")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, shared, window)
        for batch in batches:
            for row, data, offsets in bw.slices(pc.struct_field(batch.column(0), text_at)):
                part = batch.slice(row, len(offsets) - 1)
                first, found = index.hits(data, offsets)
                spans, ids = part.column(2).to_pylist(), part.column(3).to_pylist()
                for text, hits in found.items():
                    spans[text] = merge([(s["start"], s["end"]) for s in spans[text]] + [(a, b) for a, b, _ in hits])
                    ids[text] = sorted({*ids[text], *(index.ids[i] for _, _, i in hits if index.ids[i] is not None)})
                made = [pa.array(np.diff(first), pa.int64()), pa.array(spans, span_type), pa.array(ids, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def merge(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """The union of [start, end) spans, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def report(found: DataFrame) -> DataFrame:
    """Counts and digest of :func:`find_spans`, per document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        field("doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold any benchmark window."""
    return from_row(find_spans(docs, benchmark, window).where(F.size("spans") == 0), docs.columns)
