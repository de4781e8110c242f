"""Best-fit packing of tokenised documents into sequences, by swap-based local search.

1. Each document becomes its token ids and one end id; only documents longer
   than a sequence are cut, the remainder first, so all later pieces are full.
2. Pieces are dealt by hash into groups of bounded size, and in a group they are
   put, in hashed order, each where it leaves the least room.
3. Local search makes the packing: the emptiest sequence in turn gives a piece, or
   exchanges one for one, two for one or one for two, with any other underfull sequence
   of the group, by the step that raises the sum of squared fills most, until it is empty
   or no step is left.
4. Sequences that are still underfull meet those of other groups in further rounds, and
   the search goes on.

Only lengths are shuffled, never texts or ids.  Groups depend on the rows alone, not on
how they are stored.  ``PASSES`` and ``ROUNDS`` bound the effort of the search; every
piece has a place at any time.

Defined cases: a null text counts as empty and gives one piece of length 1;
repeated rows and null ids are packed as they are; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiloom.llm import bytewise as bw
from topiloom.llm.common import cut, trim_worker

SEQUENCE = 2048
END_ID = 0
GROUP_PIECES = 4096
#: Sweeps over a group's underfull sequences, and rounds in which groups meet, at most.
PASSES, ROUNDS = 8, 4
#: Texts with a longer run of blanks, or of anything else, go through the library itself.
LONG_RUN = 512

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of a byte-level BPE vocabulary file of the ``tokenizers`` library, equal to
    those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``: the
    string of a special token in a text is that token, as the library has it by default.
    ``specials_as_text`` makes it ordinary text, like the library's ``encode_special_tokens``.

    The file's vocabulary is run by tiktoken's engine, which is three times faster (the
    tests hold it against an unmodified ``Tokenizer``).  That engine merges a long run
    without a break in quadratic time, so texts with a run of more than ``LONG_RUN`` bytes
    go through ``tokenizers``.
    """

    def __init__(self, path: str, specials_as_text: bool = False):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        known = _byte_characters()
        ranks = {bytes(known[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set() if specials_as_text else set(special)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = specials_as_text

    def batch(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; a null has none."""
        for row, data, offsets in bw.slices(column):
            slow = np.zeros(len(offsets) - 1, dtype=bool)
            for inside in (bw.SOLID, ~bw.SOLID):
                starts, ends, _ = bw.words(data, offsets, inside)
                slow[np.searchsorted(offsets, starts[ends - starts > LONG_RUN], side="right") - 1] = True
            for k, text in enumerate(column.slice(row, len(offsets) - 1).to_pylist()):
                yield self.reference_ids(text) if slow[k] else self.ids(text)

    def ids(self, text: str | None) -> np.ndarray:
        return np.asarray(self.fast.encode_to_numpy(text or "", allowed_special=self.special, disallowed_special=()), dtype="<u4")

    def reference_ids(self, text: str | None) -> np.ndarray:
        return np.array(self.library.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE files: printable Latin-1
    characters stand for their own byte, the other bytes for U+0100 onwards."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in printable}
    for i, b in enumerate(b for b in range(256) if b not in set(printable)):
        out[chr(0x100 + i)] = b
    return out


def piece_lengths(total: int, limit: int = SEQUENCE) -> list[int]:
    """Lengths of a document's pieces: one if it fits, else full ones after the remainder."""
    if total <= limit:
        return [total]
    rest = total % limit
    return [rest] * (rest > 0) + [limit] * (total // limit)


def pieces(docs: DataFrame, tokenizer: str, limit: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False, specials_as_text: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents; ``with_ids``
    adds the ids themselves, for writing the packed sequences out."""
    end = np.array([end_id], dtype="<u4")
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, specials_as_text)
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.batch(batch.column(1))):
                ids = np.concatenate([ids, end])
                at = 0
                for k, n in enumerate(piece_lengths(len(ids), limit)):
                    part = ids[at : at + n]
                    row = (doc_id, k, at, n, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else []))
                    for column, value in zip(out, row):
                        column.append(value)
                    at += n
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded(batches)
        trim_worker()  # the vocabulary has gone

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, limit: int = SEQUENCE) -> list[list[int]]:
    """Each item in turn goes where it leaves the least room; the result lists items by bin."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    open_rooms = 0  # bit r: a bin with room r exists
    for item, n in enumerate(lengths.tolist()):
        fitting = open_rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            where = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
            bins[where].append(item)
        else:
            room, where = limit, len(bins)
            bins.append([item])
        left = room - n
        if left:
            by_room[left].append(where)
            open_rooms |= 1 << left
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, limit: int = SEQUENCE, passes: int = PASSES) -> list[list[int]]:
    """Drains underfull bins by moves and exchanges that raise the sum of squared fills.

    A pass takes the underfull bins from the emptiest on, each against all others.  The
    search ends when a pass changes nothing, when the total allows no fewer bins, or after
    ``passes``.
    """
    size = lengths.astype(np.int32)
    bins = [list(b) for b in bins]
    fill = np.array([int(size[b].sum()) for b in bins], dtype=np.int32)
    owner = np.empty(len(size), dtype=np.int64)
    for k, b in enumerate(bins):
        owner[b] = k
    least = -(-int(size.sum(dtype=np.int64)) // limit)
    alive = len(bins)
    for _ in range(passes):
        changed = False
        for source in np.argsort(fill, kind="stable").tolist():
            if alive <= least:
                return [b for b in bins if b]
            while 0 < fill[source] < limit and _improve(bins, fill, owner, size, source, limit):
                changed = True
                alive -= not fill[source]
        if not changed:
            break
    return [b for b in bins if b]


def _improve(bins: list[list[int]], fill: np.ndarray, owner: np.ndarray, size: np.ndarray, source: int, limit: int) -> bool:
    """The best step between ``source`` and any other underfull bin, if one raises the squared fill.

    A piece of the source moves, or one or two are exchanged for one; where that gives no
    step, one is exchanged for two.  Of its pieces of equal size the first stands for all.
    """
    by_size: dict[int, list[int]] = {}
    for x in bins[source]:
        by_size.setdefault(int(size[x]), []).append(x)
    one = [own[:1] for own in by_size.values()]
    two = [a + b for i, a in enumerate(one) for b in one[:i]] + [own[:2] for own in by_size.values() if len(own) > 1]
    mine = np.array(list(by_size), dtype=np.int32)
    total = np.concatenate([mine, np.array([size[a] + size[b] for a, b in two], dtype=np.int32)])
    open_ = (fill < limit) & (fill > 0)
    open_[source] = False
    items, others = np.flatnonzero(open_[owner]), np.flatnonzero(open_)
    back = np.concatenate([size[items], np.zeros(len(others), dtype=np.int32)])
    where = np.concatenate([owner[items], others])
    step = _best(total, back, fill[where], int(fill[source]), limit)
    if step is not None:
        leaving, coming, target = (one + two)[step[0]], [int(items[step[1]])] if step[1] < len(items) else [], int(where[step[1]])
    else:
        x, y = _pairs(items[np.argsort(owner[items], kind="stable")], owner)
        step = _best(mine, size[x] + size[y], fill[owner[x]], int(fill[source]), limit)
        if step is None:
            return False
        leaving, coming, target = one[step[0]], [int(x[step[1]]), int(y[step[1]])], int(owner[x[step[1]]])
    for x in leaving:
        bins[source].remove(x)
        bins[target].append(x)
        owner[x] = target
    for x in coming:
        bins[target].remove(x)
        bins[source].append(x)
        owner[x] = source
    moved = sum(int(size[x]) for x in leaving) - sum(int(size[x]) for x in coming)
    fill[source] -= moved
    fill[target] += moved
    return True


def _best(total: np.ndarray, back: np.ndarray, level: np.ndarray, fill: int, limit: int) -> tuple[int, int] | None:
    """Of exchanging a sum of ``total`` in a bin of ``fill`` for one of ``back`` in bins of
    ``level``: the choice that raises the sum of squared fills most, if any does."""
    moved = total[:, None] - back[None, :]
    gain = moved * (level[None, :] - fill + moved)  # half of the rise
    gain[(moved <= 0) | (moved > limit - level[None, :])] = 0
    if not gain.size or gain.max() <= 0:
        return None
    a, k = np.unravel_index(int(gain.argmax()), gain.shape)
    return int(a), int(k)


def _pairs(items: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``items`` (in the order of their bins) that share a bin."""
    left, right, apart = [items[:0]], [items[:0]], 1
    while apart < len(items) and (same := owner[items[:-apart]] == owner[items[apart:]]).any():
        left.append(items[:-apart][same])
        right.append(items[apart:][same])
        apart += 1
    return np.concatenate(left), np.concatenate(right)


PACKED = PIECES + ", sequence_id long, offset long, fill long"


def pack_group(rows: pa.Table, base: int = 0, limit: int = SEQUENCE) -> pa.Table:
    """Packs one bounded group: adds (or renews) sequence_id, offset and fill.

    Rows that have a sequence_id and offset start from there, others (with ``turn``, by
    which they come) from a first packing, whose numbers begin at ``base``.
    """
    order = ("sequence_id", "offset") if "sequence_id" in rows.column_names else ("turn", "doc_id", "piece", "start", "length", "ids_crc32")
    rows = rows.sort_by([(c, "ascending") for c in order])
    lengths = rows["length"].to_numpy()
    if "sequence_id" in rows.column_names:
        names, bin_of = np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)
        start = [np.flatnonzero(bin_of == k).tolist() for k in range(len(names))]
    else:
        start = best_fit(lengths, limit)
        names = base + np.arange(len(start))
    first = np.empty(len(lengths), np.int64)
    for name, items in zip(names, start):
        first[items] = name
    sequence, offset, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free = set(names.tolist())
    for items in local_search(start, lengths, limit):
        # a name that any of its pieces has had; there are never more sequences than names
        name = next((int(first[i]) for i in items if first[i] in free), None)
        if name is None:
            name = min(free)
        free.discard(name)
        at = 0
        for i in sorted(items):
            sequence[i], offset[i] = name, at
            at += int(lengths[i])
        fill[items] = at
    kept = rows.select(["doc_id", "piece", "start", "length", "ids_crc32"])
    return kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill))


def pack(cut_pieces: DataFrame, limit: int = SEQUENCE, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to rows of :func:`pieces`.

    ``cut_pieces`` should be a stored table: its rows are counted, then packed.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    groups = max(1, -(-cut_pieces.count() // group_pieces))
    # equal rows are told apart by a number, which does not depend on where they are stored
    equal = cut_pieces.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    dealt = equal.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    turn = F.xxhash64(*columns, "_copy")
    dealt = dealt.select(*columns, turn.alias("turn"), F.pmod(turn, F.lit(groups)).alias("_group"))
    done = None
    for round_ in range(rounds):

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            return pack_group(rows.drop_columns("_group"), key[0].as_py() << 32, limit)

        packed = cut(dealt.groupBy("_group").applyInArrow(run, PACKED), "packed")
        loose = packed.where(F.col("fill") < limit)
        if groups == 1 or round_ == rounds - 1:
            break
        full = packed.where(F.col("fill") == limit)
        done = full if done is None else done.unionByName(full)
        groups = max(1, -(-loose.count() // group_pieces))
        dealt = loose.select(*columns, "sequence_id", "offset", F.pmod(F.xxhash64("sequence_id", F.lit(round_)), F.lit(groups)).alias("_group"))
    out = packed if done is None else done.unionByName(packed)
    return out.drop("fill")


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = SEQUENCE) -> DataFrame:
    """Tokenises and packs ``docs`` (doc_id, text): one row per piece with its place."""
    return pack(cut(pieces(docs, tokenizer, limit), "pieces"), limit)
