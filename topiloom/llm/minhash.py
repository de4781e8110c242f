"""Near-duplicate documents by MinHash with tensored banding.

Documents are linked when the Jaccard similarity of their sets of word shingles
reaches a threshold, and grouped by links.

A table of plain banding has a key of 2r minhashes, and L tables need 2rL of them.
Tensoring makes two collections of m keys, r minhashes each, and forms the keys of
m * m tables by combining every key of the first with every key of the second: 2rm
minhashes stand for L = m * m tables.  Here r = 3 and m = 20, so 120 minhashes
make 400 tables with keys of 6; a pair at similarity 0.75 misses all of them with
a chance of 4 in 100 000, at 0.8 of 1 in 1 000 000.  Pairs in a table whose sketches
agree in less than ``LEAST_ESTIMATE`` are let go, which a pair at 0.75 meets with a chance
of 1 in 10 000 000, so 4 in 100 000 is the whole chance of a miss.

The 20 tables that share a first key lie in one bucket, so that only first keys
are shuffled; the second keys open the tables inside a task.

1. One pass over the texts makes a sketch per document; equal sets become one node.
2. Buckets with one node fall away.  The rest are dealt into blocks of bounded
   size, and in a block each node proposes its likeliest table mate.
3. Proposals are confirmed on the full sets, and linked nodes are joined.
4. Buckets that still hold several components are compared block against block,
   but for pairs that already are of one component.  Sketches alone tell which nodes
   have a likely partner there; only those are sent their full sets, and their pairs
   are confirmed on the spot, likeliest first.  What they link completes the groups.

Copies are never expanded into pairs, no bucket is capped, and no bucket has to
fit into one task.

Defined cases: a text of fewer words than a shingle is one shingle of all of them;
a null, empty or blank text has none and is linked with nothing; repeated rows and
equal ids are rows of their own; a null id makes a row that is kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiloom.llm import bytewise as bw
from topiloom.llm.common import Scratch, as_row, cut, field, from_row, hot_rows, release_shuffles, salted, with_value
from topiloom.llm.components import components

SHINGLE_WORDS = 5
PERCENT = 75
KEYS = 20
ROWS = 3
BLOCK = 256
#: Pairs whose sketches agree in less than this share of minhashes are let go.
LEAST_ESTIMATE = 0.52
#: A table of at most so many ids (some 40 MB) is broadcast to the texts; beyond it, texts
#: are shuffled by id.
BROADCAST_IDS = 1 << 19


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    for _, data, offsets in bw.slices(column):
        starts, ends, first = bw.words(data, offsets, bw.SOLID)
        hashes = bw.word_hashes(data, starts, ends)
        whole = bw.grams(hashes, SHINGLE_WORDS)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= SHINGLE_WORDS:
                found = np.sort(whole[a : b - SHINGLE_WORDS + 1])
                yield found[np.concatenate([[True], found[1:] != found[:-1]])]
            else:
                yield bw.grams(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _factors(n: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(b"minhash%d" % j, digest_size=8).digest(), "little") | 1 for j in range(n)], dtype=np.uint64)


def minhashes(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(found), 2048):
        np.minimum(out, (factors[:, None] * found[None, a : a + 2048]).min(axis=1), out=out)
    return bw.mix(out)


def _set_id(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, n_shingles, sid, keys, low): ``hash`` is that of the text, ``sid`` names
    the set, ``keys`` are the first keys, ``low`` has a byte of every minhash, those of the
    second keys last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(2 * KEYS * ROWS)
        salt = np.arange(KEYS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            size, sid, keys, low = [], [], [], []
            for found in shingle_sets(batch.column(1)):
                size.append(len(found))
                if not len(found):
                    for column in (sid, keys, low):
                        column.append(None)
                    continue
                least = minhashes(found, factors)
                first = least[: KEYS * ROWS].reshape(KEYS, ROWS)
                key = salt.copy()
                for r in range(ROWS):
                    key = bw.mix(key ^ first[:, r])
                sid.append(_set_id(found))
                keys.append(key.view(np.int64))
                low.append(least.astype(np.uint8).tobytes())
            arrays = [batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(sid, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "hash", "n_shingles", "sid", "keys", "low"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text)).mapInArrow(run, "doc_id long, hash long, n_shingles long, sid binary, keys array<long>, low binary")


def _runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Cuts a stream that is sorted by its first ``columns`` columns so that no group is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = _changes(batch, columns)
        if held and not _same(held[-1], batch, columns):
            yield pa.Table.from_batches(held)
            held = []
        if len(changed):
            yield pa.Table.from_batches([*held, batch.slice(0, int(changed[-1]))])
            held = [batch.slice(int(changed[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _changes(rows: pa.RecordBatch | pa.Table, columns: int) -> np.ndarray:
    """Where a new group begins, the first left out."""
    new = np.zeros(max(0, rows.num_rows - 1), dtype=bool)
    for c in range(columns):
        x = rows.column(c).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(c).to_numpy()
        new |= x[1:] != x[:-1]
    return np.flatnonzero(new) + 1


def _same(a: pa.RecordBatch, b: pa.RecordBatch, columns: int) -> bool:
    return all(a.column(c)[-1].as_py() == b.column(c)[0].as_py() for c in range(columns))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), 2 * KEYS * ROWS)


def _share(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of rows of ``a`` with rows of ``b`` (broadcast), and whether a table has both.

    The rows are of one bucket, so the first key is common; a second key must be too.
    """
    equal = a == b
    second = equal[..., KEYS * ROWS :].reshape(*equal.shape[:-1], KEYS, ROWS).all(axis=-1).any(axis=-1)
    share = equal.mean(axis=-1, dtype=np.float32)
    return (share - 1 / 256) / (1 - 1 / 256), second


PROPOSED = "u binary, v binary, estimate float"


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's likeliest table mate in its block; columns: key, block, sid, low."""
    for rows in _runs(batches, 2):
        starts = np.concatenate([[0], _changes(rows, 2), [rows.num_rows]])
        low, sid = _matrix(rows.column(3)), rows.column(2).to_pylist()
        u, v, estimate = [], [], []
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        share, second = _share(low[two], low[two + 1])
        for k in np.flatnonzero(second & (share >= LEAST_ESTIMATE)).tolist():
            u += [two[k], two[k] + 1]
            v += [two[k] + 1, two[k]]
            estimate += [share[k], share[k]]
        for k in np.flatnonzero(sizes > 2).tolist():
            a, b = int(starts[k]), int(starts[k + 1])
            for i in range(a, b, 64):
                share, second = _share(low[i : min(b, i + 64), None, :], low[None, a:b, :])
                share[~second] = -1
                share[np.arange(len(share)), np.arange(i - a, i - a + len(share))] = -1  # a node itself
                mate, best = share.argmax(axis=1), share.max(axis=1)
                for j in np.flatnonzero(best >= LEAST_ESTIMATE).tolist():
                    u.append(i + j)
                    v.append(a + int(mate[j]))
                    estimate.append(best[j])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array([sid[i] for i in u], pa.binary()), pa.array([sid[i] for i in v], pa.binary()), pa.array(estimate, pa.float32())], names=["u", "v", "estimate"])


MEETING = "key long, left int, right int, side int, sid binary, comp binary, low binary, keys array<long>, size long"


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each pair of blocks: the rows (columns of ``MEETING``), where its own begin and end,
    and its likely pairs: share, one row, the other, and the components of all rows.

    ``side`` is 0 for rows of the left block, 1 for rows of the right one, 0 for
    both where they are the same.  A pair is looked at in the first bucket that it shares.
    """
    for rows in _runs(batches, 3):
        starts = np.concatenate([[0], _changes(rows, 3), [rows.num_rows]])
        key, side, size = rows.column(0).to_numpy(), rows.column(3).to_numpy(), rows.column(8).to_numpy()
        left, right = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        low = _matrix(rows.column(6))
        keys = np.stack(rows.column(7).to_pylist()).astype(np.int64)
        names: dict[bytes, int] = {}
        comp = np.array([names.setdefault(c, len(names)) for c in rows.column(5).to_pylist()])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            own = left[a] == right[a]
            one = np.arange(a, b) if own else a + np.flatnonzero(side[a:b] == 0)
            two = one if own else a + np.flatnonzero(side[a:b] == 1)
            likely = [(np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for i in range(0, len(one), 64):
                x = one[i : i + 64]
                share, second = _share(low[x, None, :], low[None, two, :])
                found = second & (share >= LEAST_ESTIMATE) & (comp[x, None] != comp[None, two])
                found &= 100 * np.minimum(size[x, None], size[None, two]) >= PERCENT * np.maximum(size[x, None], size[None, two])
                if own:
                    found &= x[:, None] < two[None, :]
                p, q = np.nonzero(found)
                p, q, share = x[p], two[q], share[p, q]
                both = keys[p] == keys[q]
                here = keys[p, both.argmax(axis=1)] == key[a] if len(p) else np.zeros(0, bool)
                likely.append((share[here], p[here], q[here]))
            yield rows, a, b, *(np.concatenate(c) for c in zip(*likely)), comp


def _partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each meeting that have a likely partner in it."""
    for rows, a, b, _, p, q, _ in _meetings(batches):
        if len(p):
            yield from rows.take(np.unique(np.concatenate([p, q]))).combine_chunks().to_batches()


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components; columns: those of ``MEETING``, full.

    Likely pairs are confirmed, likeliest first; what has been linked here is one
    component from then on, so that a dense group yields a tree of links.
    """
    for rows, a, b, share, p, q, comp in _meetings(batches):
        part = rows.slice(a, b - a)
        sid, full = part.column(4).to_pylist(), part.column(9).combine_chunks()
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in full]
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:  # noqa: B023
                c = joined[c]  # noqa: B023
            return c

        u, v = [], []
        for j in np.argsort(-share, kind="stable").tolist():
            c, d = root(int(comp[p[j]])), root(int(comp[q[j]]))
            if c != d and _linked(sets[p[j] - a], sets[q[j] - a]):
                joined[max(c, d)] = min(c, d)
                u.append(sid[p[j] - a])
                v.append(sid[q[j] - a])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles reach the threshold."""
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= PERCENT * (len(both) - common)


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, full) of the ``wanted`` nodes (sid, doc_id; a stored table), from their documents' whole texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = wanted.select("sid", F.col("doc_id").alias("_doc"))
    named = F.broadcast(named) if wanted.count() <= BROADCAST_IDS else named.hint("shuffle_hash")
    found = texts.join(named, texts["doc_id"].eqNullSafe(F.col("_doc"))).select("sid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, full = batch.column(0).to_pylist(), []
            own = []
            for name, found in zip(sid, shingle_sets(batch.column(1))):
                if len(found) and _set_id(found) == name:  # an id may stand for several texts
                    own.append(name)
                    full.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(full, pa.binary())], names=["sid", "full"])

    return found.mapInArrow(run, "sid binary, full binary").dropDuplicates(["sid"])


def _confirm(pairs: DataFrame, full: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (u, v; a stored table) that reach the threshold on their full sets.

    A node may be the likeliest mate of very many; its pairs meet its set in parts."""
    n = pairs.count()
    left = full.select(F.col("sid").alias("_key"), F.col("full").alias("fu"))
    right = full.select(F.col("sid").alias("_key"), F.col("full").alias("fv"))
    parts = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows(n))
    both = salted(pairs, "u", left, n)
    if parts.take(1):  # hubs on this side as well: store what the second join deals
        both = scratch.cut(both, "half")
        both = salted(both, "v", right, n).select("u", "v", "fu", "fv")
    else:
        both = both.join(right, F.col("v") == F.col("_key")).select("u", "v", "fu", "fv")

    both = both.where("fu IS NOT NULL AND fv IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_linked(np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(b.as_buffer(), dtype=np.uint64)) for a, b in zip(batch.column(2), batch.column(3))]
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["u", "v"])

    return both.mapInArrow(run, "u binary, v binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    return _groups(docs).select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def _groups(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, n_shingles, root, component): a stored table with a row for every row of
    ``docs``; ``root`` names the group, and is null where there are no shingles."""
    scratch = Scratch(docs.sparkSession)
    sketch = scratch.cut(sketches(docs), "sketch")
    of_set = sketch.where("sid IS NOT NULL").groupBy("sid")
    nodes = scratch.cut(of_set.agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("low").alias("low"), F.first("n_shingles").alias("size"), F.count(F.lit(1)).alias("n")), "nodes", release=True)

    entries = nodes.select("sid", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("_key"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = entries.join(shared, F.col("key") == F.col("_key")).select("sid", "key", "blocks")
    members = scratch.cut(members.join(nodes.select("sid", "low"), "sid"), "members", release=True)
    wanted = scratch.cut(members.select("sid").distinct().join(nodes.select("sid", "doc_id"), "sid"), "wanted")
    full = scratch.cut(_full_sets(docs, wanted), "sets", release=True)

    pairs = scratch.cut(_proposals(members), "pairs", release=True)
    links = scratch.cut(_confirm(pairs, full, scratch), "links", release=True)
    groups = components(links)
    likely = scratch.cut(_open_pairs(members, nodes, groups), "likely", release=True)
    more = scratch.cut(_open_links(likely, full), "links", release=True)
    if more.take(1):
        groups = components(links.unionByName(more))
    label = scratch.cut(_labels(nodes, groups), "labels")
    out = cut(_labelled(sketch, nodes, label), "groups")
    scratch.drop()
    release_shuffles(docs.sparkSession)
    return out


def _proposals(members: DataFrame) -> DataFrame:
    """The pair (u, v) of each node with its likeliest table mate."""
    block = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    dealt = members.select("key", block.alias("block"), "sid", "low").repartition("key", "block").sortWithinPartitions("key", "block")
    best = dealt.mapInArrow(_propose, PROPOSED).groupBy("u").agg(F.max(F.struct("estimate", "v")).alias("b"))
    return best.select(F.least("u", "b.v").alias("u"), F.greatest("u", "b.v").alias("v")).distinct()


def _open_pairs(members: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of ``MEETING``: nodes that meet a likely partner of another component in a bucket.

    In each bucket the most frequent component is set apart in blocks of its own,
    which are not compared with each other.
    """
    known = groups.select(F.col("node").alias("_node"), "root")
    named = members.select("key", "sid", "low").join(known, F.col("sid") == F.col("_node"), "left").select("key", "sid", "low", F.coalesce("root", "sid").alias("comp"))
    sizes = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy(F.col("key").alias("_key")).agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    main = main.select("_key", F.col("m.comp").alias("_main"), F.ceil(F.col("m.n") / BLOCK).cast("int").alias("_mains"), F.ceil((F.col("n") - F.col("m.n")) / BLOCK).cast("int").alias("_others"))
    dealt = named.join(main, F.col("key") == F.col("_key"))
    is_main = F.col("comp") == F.col("_main")
    # blocks 0 .. others-1 are of the other components, those after them of the main one
    block = F.when(is_main, F.col("_others") + F.pmod(F.xxhash64("sid"), F.col("_mains"))).otherwise(F.pmod(F.xxhash64("sid"), F.col("_others"))).cast("int")
    dealt = dealt.withColumn("b", block)
    everywhere = F.sequence(F.lit(0), F.col("_others") + F.col("_mains") - 1)
    partners = F.when(is_main, F.sequence(F.lit(0), F.col("_others") - 1)).otherwise(everywhere)
    dealt = dealt.withColumn("c", F.explode(partners))
    dealt = dealt.select("key", F.least("b", "c").alias("left"), F.greatest("b", "c").alias("right"), F.when(F.col("b") <= F.col("c"), 0).otherwise(1).alias("side"), "sid", "comp", "low")
    dealt = dealt.join(nodes.select("sid", "keys", "size"), "sid").select("key", "left", "right", "side", "sid", "comp", "low", "keys", "size")
    return dealt.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right").mapInArrow(_partnered, MEETING)


def _open_links(likely: DataFrame, full: DataFrame) -> DataFrame:
    """Links (u, v) among the nodes of :func:`_open_pairs`, confirmed on their full sets."""
    dealt = likely.join(full, "sid").select(*likely.columns, "full")
    return dealt.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right").mapInArrow(_cross, "u binary, v binary")


def _labels(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(sid, root, label) of every node; ``label`` is the least id of its group."""
    named = nodes.join(groups, F.col("sid") == F.col("node"), "left").select("sid", "doc_id", F.coalesce("root", "sid").alias("root"))
    least = named.groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("label"))
    hot = least.join(named.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows(nodes.count())), F.col("_root") == F.col("root"), "left_semi")
    return with_value(named, "root", least.withColumnRenamed("_root", "_key"), hot.withColumnRenamed("_root", "_key")).select("sid", "root", "label")


def _labelled(sketch: DataFrame, nodes: DataFrame, label: DataFrame) -> DataFrame:
    """Every row of ``sketch`` with its group and the least id in it."""
    rows = sketch.select("doc_id", "hash", "n_shingles", "sid")
    values = label.select(F.col("sid").alias("_key"), "root", "label")
    many = nodes.where(F.col("n") > hot_rows(rows.count())).select(F.col("sid").alias("_hot"))
    hot = values.join(many, F.col("_key") == F.col("_hot"), "left_semi")
    told = with_value(rows.where("sid IS NOT NULL"), "sid", values, hot)
    alone = rows.where("sid IS NULL").withColumns({"root": F.lit(None).cast("binary"), "label": F.col("doc_id")})
    return told.unionByName(alone).select("doc_id", "hash", "n_shingles", "root", F.coalesce("label", "doc_id").alias("component"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that with the least id, among equal ids that with
    the least hash of its text.  Rows without an id and texts without a word all stay.

    Where few rows go, their ids and hashes are broadcast and no text moves; beyond that,
    texts are shuffled once by id.
    """
    grouped = _groups(docs).where("doc_id IS NOT NULL AND root IS NOT NULL")
    first = F.min(F.struct("doc_id", "hash"))
    stay = grouped.groupBy("root").agg(first.alias("s")).select("s.*").distinct()
    pairs = grouped.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n"))
    judged = cut(pairs.join(stay.withColumn("stays", F.lit(True)), ["doc_id", "hash"], "left").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), F.col("stays").isNotNull().alias("stays"), "n"), "judged")
    text = field("text").cast("string")
    rows = as_row(docs).select("row", field("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("solid"))
    on = (F.col("id") == F.col("_id")) & (F.col("hash") == F.col("_hash")) & F.col("solid")
    # of a row that is there several times, with all its texts, one is picked below
    gone = judged.where("NOT stays OR n > 1")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("shuffle_hash")
    kept = rows.join(gone, on, "left_anti").select("row")
    repeated = judged.where("stays AND n > 1")
    if repeated.take(1):
        same = rows.join(repeated, on).groupBy("_id", "_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.unionByName(same.select("row"))
    return from_row(kept, docs.columns)
