"""Language identification by a linear-chain conditional random field over words.

Each word gets a label, so texts that switch between languages are labelled piece by
piece.  A word's score for a label is a sum of weights over its features: the word
itself (a lexicon learned from the training texts), prefixes and suffixes of up to
three bytes, and byte n-grams; features are hashed into a table of fixed size.
Learned transitions tie neighbouring labels together.  Forward-backward gives every
word's posterior; the text's language is the label with the largest mean posterior,
and that mean is the score.

Training takes a bounded sample of labelled rows to the driver: about equally many texts
of each label, ``TRAIN_DOCS`` in all, picked by a hash, of each a stretch of ``TRAIN_CHARS``
characters that begins at a hashed place, and of these ``TRAIN_WORDS`` words.  Only the
``TRAIN_LABELS`` most frequent labels are learned.  The sample takes two jobs, however many
partitions there are.  Sequences are spliced from pieces of several texts, so that switches
are there to be learned.  Prediction streams over whole texts; a text of any length keeps
one pass forward and one back.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; rows
without a label are predicted but not learned from; without any labelled row all are
``und``; repeated rows and null ids are rows of their own; an empty table gives no
rows; other columns are kept as they are, but ``lang_pred`` and ``score`` of
:func:`identify` take the place of columns of these names.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topiloom.llm import bytewise as bw
from topiloom.llm.common import as_row, field, from_row, trim_worker

UNKNOWN = "und"
#: A document is rejected when the score of its likeliest language is less than this share
#: of the way from chance (one over the number of languages) to certainty.
LEAST_EXCESS = 0.2
BITS = 17
TRAIN_DOCS = 1600
TRAIN_CHARS = 2000
TRAIN_LABELS = 200
TRAIN_WORDS = 160_000
PIECE_WORDS = 12
SEQUENCE_WORDS = 36
EPOCHS = 3
BATCH = 128
RATE = 0.05
DECAY = 1e-4
SEED = 7
#: Of texts whose words are labelled together; more than ``SLICE_LABELS`` labels take less text, ``LEAST_SLICE`` at least.
SLICE_BYTES, SLICE_LABELS, LEAST_SLICE = 2 << 20, 4, 64 << 10
#: Of words whose features stand in memory together, times labels; and the least of one part.
PART_BYTES, LEAST_PART = 256 << 10, 4 << 10


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words, and where each word's begin (words must not be empty)."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)])
    inside = np.arange(at[-1]) - np.repeat(at[:-1], size)  # place in the word
    b = bw.LOWER[data[np.repeat(starts, size) + inside]].astype(np.uint32) + np.uint32(1)
    left = np.repeat(size, size) - inside  # bytes from here to the end of the word
    next1 = np.where(left > 1, np.append(b[1:], 0), 0).astype(np.uint32)
    next2 = np.where(left > 2, np.append(b[2:], [0, 0])[: len(b)], 0).astype(np.uint32)
    two = b * np.uint32(0x9E3779B1) + next1 * np.uint32(0x85EBCA77)
    three = two + next2 * np.uint32(0xC2B2AE3D)
    first = (inside == 0).astype(np.uint32)
    # every place gives a bigram and a trigram; a word's last ones take its end for a letter
    kinds = [_mix(two ^ np.uint32(0x1234567)), _mix(three ^ np.uint32(0x89ABCD1)), _mix(three * np.uint32(5) + first * np.uint32(0x27D4EB2F))]
    begin, last = at[:-1], at[1:] - 1
    prefixes = [_mix(x[begin] + np.uint32(k * 0x165667B1 + 11)) for k, x in enumerate((b, two, three))]
    back = [last, np.maximum(last - 1, begin), np.maximum(last - 2, begin)]
    suffixes = [_mix(x[p] + np.uint32(k * 0x165667B1 + 77)) for k, (x, p) in enumerate(zip((b, two, three), back))]
    lexicon = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    single = np.stack([lexicon, *prefixes, *suffixes], axis=1)
    per_place = np.stack(kinds, axis=1)
    offsets = np.arange(len(size)) * single.shape[1] + begin * per_place.shape[1]
    out = np.empty(single.size + per_place.size, dtype=np.int64)
    out[(offsets[:, None] + np.arange(single.shape[1])).ravel()] = single.ravel()
    place = np.repeat(offsets + single.shape[1], size) + inside * per_place.shape[1]
    out[(place[:, None] + np.arange(per_place.shape[1])).ravel()] = per_place.ravel()
    return out, offsets


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    return (x >> np.uint32(32 - BITS)).astype(np.int64)


@dataclasses.dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (features, labels)
    moves: np.ndarray  # (labels, labels), log scale

    def unary(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Scores of words; features are made and dropped for ``PART_BYTES`` / labels bytes of words at a time."""
        out = np.empty((len(starts), len(self.labels)), dtype=np.float32)
        limit = max(LEAST_PART, PART_BYTES // len(self.labels))
        before, a = np.concatenate([[0], np.cumsum(ends - starts)]), 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(before, before[a] + limit, side="right")) - 1)
            ids, offsets = features(data, starts[a:b], ends[a:b], hashes[a:b])
            out[a:b] = np.add.reduceat(self.weights[ids], offsets, axis=0)
            a = b
        return out


def _softened(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=-1, keepdims=True)).astype(np.float64)


def posteriors(emit: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Posterior label probabilities of all words of all texts, by forward-backward.

    ``emit``: (words, labels), positive; ``moves``: positive; ``first``: words before each text.
    All texts take a step together; the longest stand first, so those that still have
    words are always the front rows.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    steps = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(steps), side="left")  # texts with more than t words
    forward = np.empty_like(emit)
    state = None
    for t in range(steps):
        at = begin[: alive[t]] + t
        state = emit[at] if t == 0 else (state[: alive[t]] @ moves) * emit[at]
        state /= state.sum(axis=1, keepdims=True)
        forward[at] = state
    back = np.ones((0, emit.shape[1]))
    turned = np.ascontiguousarray(moves.T)
    for t in range(steps - 1, -1, -1):
        at = begin[: alive[t]] + t
        if len(back) < alive[t]:  # texts that end here
            back = np.concatenate([back, np.ones((alive[t] - len(back), emit.shape[1]))])
        joint = forward[at] * back
        forward[at] = joint / joint.sum(axis=1, keepdims=True)
        back = (back * emit[at]) @ turned
        back /= back.sum(axis=1, keepdims=True)
    return forward


def train(texts: list[tuple[str, str]], words_bound: int = TRAIN_WORDS, seed: int = SEED) -> Model | None:
    """Fits the field to (text, label) pairs, on at most ``words_bound`` words."""
    labels = sorted({y for _, y in texts})
    column = pa.array([t for t, _ in texts], pa.large_string())
    data, starts, ends, pieces = [], [], [], []
    base = 0
    number = {y: i for i, y in enumerate(labels)}
    for row, part, offsets in bw.slices(column):
        s, e, first = bw.words(part, offsets, bw.ALPHA)
        done = sum(map(len, starts))
        starts.append(s + base)
        ends.append(e + base)
        data.append(part)
        base += len(part)
        for k in range(len(offsets) - 1):
            y = number[texts[row + k][1]]
            pieces += [(done + a, done + min(a + PIECE_WORDS, int(first[k + 1])), y) for a in range(int(first[k]), int(first[k + 1]), PIECE_WORDS)]
    if not pieces:
        return None
    data, starts, ends = np.concatenate(data), np.concatenate(starts), np.concatenate(ends)
    rng = np.random.default_rng(seed)
    by_label = [[p for p in pieces if p[2] == y] for y in range(len(labels))]
    by_label = [[own[i] for i in rng.permutation(len(own))[: max(1, words_bound // PIECE_WORDS // len(labels))]] for own in by_label if own]
    pool = [p for own in by_label for p in own]
    pool = [pool[i] for i in rng.permutation(len(pool))]
    # Half of the sequences hold pieces of one label, half change it from piece to piece.
    same = [p for own in by_label for p in own[: len(own) // 2]]
    mixed = [p for own in by_label for p in own[len(own) // 2 :]]
    mixed = [mixed[i] for i in rng.permutation(len(mixed))]
    joined = same + mixed
    per = SEQUENCE_WORDS // PIECE_WORDS
    sequences = [joined[i : i + per] for i in range(0, len(joined), per)]

    hashes = bw.word_hashes(data, starts, ends)
    _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    ids, offsets = features(data, starts[at], ends[at], hashes[at])
    sizes = np.diff(np.append(offsets, len(ids)))
    n = len(labels)
    weights, moves = np.zeros((1 << BITS, n)), np.zeros((n, n))
    square_w, square_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(sequences))
        for b in range(0, len(shuffled), BATCH):
            batch = [sequences[i] for i in shuffled[b : b + BATCH]]
            words = np.concatenate([np.arange(x, y) for s in batch for x, y, _ in s])
            truth = np.concatenate([np.full(y - x, z) for s in batch for x, y, z in s])
            first = np.concatenate([[0], np.cumsum([sum(y - x for x, y, _ in s) for s in batch])])
            distinct, place = np.unique(inverse[words], return_inverse=True)
            flat = np.concatenate([ids[offsets[u] : offsets[u] + sizes[u]] for u in distinct])
            starts_at = np.concatenate([[0], np.cumsum(sizes[distinct])])
            unary = np.add.reduceat(weights[flat], starts_at[:-1], axis=0)
            emit, move = _softened(unary)[place], np.exp(moves)
            gamma = posteriors(emit, move, first)
            wrong = gamma.copy()
            wrong[np.arange(len(truth)), truth] -= 1
            per_word = np.stack([np.bincount(place, weights=wrong[:, y], minlength=len(distinct)) for y in range(n)], axis=1)
            spread = np.repeat(per_word, sizes[distinct], axis=0)
            slope = np.stack([np.bincount(flat, weights=spread[:, y], minlength=1 << BITS) for y in range(n)], axis=1) / len(words) * 50
            slope += DECAY * weights
            square_w += slope**2
            weights -= RATE * slope / np.sqrt(square_w)
            moved = _pair_counts(emit, move, first) - _true_pairs(truth, first, n)
            slope = moved / len(words) * 50 + DECAY * moves
            square_m += slope**2
            moves -= RATE * slope / np.sqrt(square_m)
    return Model(labels, weights.astype(np.float32), moves)


def _inner(first: np.ndarray) -> np.ndarray:
    """Words that have a word before them in their text."""
    inside = np.ones(first[-1], dtype=bool)
    inside[first[:-1][np.diff(first) > 0]] = False
    return np.flatnonzero(inside)


def _true_pairs(truth: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    at = _inner(first)
    return np.bincount(truth[at - 1] * n + truth[at], minlength=n * n).reshape(n, n).astype(float)


def _pair_counts(emit: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Expected numbers of label pairs; equal-length batches make this short enough in plain steps."""
    n = emit.shape[1]
    total = np.zeros((n, n))
    size = np.diff(first)
    steps = int(size.max()) if len(size) else 0
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    alive = np.searchsorted(-size, -np.arange(steps), side="left")
    forward = np.empty_like(emit)
    state = None
    for t in range(steps):
        at = begin[: alive[t]] + t
        state = emit[at] if t == 0 else (state[: alive[t]] @ move) * emit[at]
        state /= state.sum(axis=1, keepdims=True)
        forward[at] = state
    back = np.ones((0, n))
    for t in range(steps - 1, 0, -1):
        at = begin[: alive[t]] + t
        if len(back) < alive[t]:
            back = np.concatenate([back, np.ones((alive[t] - len(back), n))])
        joint = forward[at - 1][:, :, None] * move[None] * (emit[at] * back)[:, None, :]
        total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = (back * emit[at]) @ move.T
        back /= back.sum(axis=1, keepdims=True)
    return total


def sample(docs: DataFrame, learnable: Column, label: str = "lang", docs_bound: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> list[tuple[str, str]]:
    """About equally many texts per label, the first by a hash, each cut to ``chars`` characters."""
    text, tag = F.col("text").cast("string"), F.col(label).cast("string")
    rows = docs.where(learnable & tag.isNotNull() & text.isNotNull()).select(tag.alias("label"), text.alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(TRAIN_LABELS).collect()}
    if not counts:
        return []
    quota = max(8, docs_bound // len(counts))
    share = F.create_map(*(F.lit(x) for y, n in counts.items() for x in (y, min(1.0, 1.5 * quota / n + 8 / n))))
    picked = rows.where((F.pmod("h", F.lit(1 << 30)) / F.lit(1 << 30)) < F.coalesce(share[F.col("label")], F.lit(0.0)))
    room = F.greatest(F.length("text") - chars, F.lit(0)) + 1
    picked = picked.select("label", "h", F.substring("text", F.pmod(F.shiftright("h", 30), room).cast("int") + 1, F.lit(chars)).alias("text"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h", "text"))
    kept = picked.withColumn("rank", rank).where(F.col("rank") <= quota)
    return [(r["text"], r["label"]) for r in sorted(kept.collect(), key=lambda r: (r["label"], r["rank"]))]


def slice_bytes(labels: int) -> int:
    """Bytes of text that are labelled together: every word has a row of ``labels`` numbers."""
    return max(LEAST_SLICE, SLICE_BYTES * SLICE_LABELS // max(SLICE_LABELS, labels))


def _labelled_words(crf: Model, move: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of all words, and how many words come before each text."""
    starts, ends, first = bw.words(data, offsets, bw.ALPHA)
    hashes = bw.word_hashes(data, starts, ends)
    _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    emit = _softened(crf.unary(data, starts[at], ends[at], hashes[at]))[inverse]
    del starts, ends, hashes, at, inverse
    return posteriors(emit, move, first), first


def predict(docs: DataFrame, model: Model | None, with_runs: bool = False) -> DataFrame:
    """row (all columns of ``docs``), lang_pred and score; ``with_runs`` adds the labelled runs of words."""
    wide = as_row(docs).select("row", F.coalesce(field("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    text_at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))
    empty_runs = F.array().cast("array<struct<start:long,stop:long,lang:string>>")
    shape = wide.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), *([empty_runs.alias("runs")] if with_runs else [])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        move = np.exp(crf.moves) if crf else None
        limit = slice_bytes(len(crf.labels)) if crf else SLICE_BYTES

        def labelled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row, data, offsets in bw.slices(pc.struct_field(batch.column(0), text_at), limit):
                part = batch.slice(row, len(offsets) - 1)
                has_letter = part.column(1).to_numpy(zero_copy_only=False)
                names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                runs: list[list[dict]] = [[] for _ in names]
                if crf:
                    gamma, first = _labelled_words(crf, move, data, offsets)
                    size = np.diff(first)
                    named = np.flatnonzero(has_letter & (size > 0))
                    filled = np.flatnonzero(size > 0)
                    mean = np.zeros((len(size), gamma.shape[1]))
                    if len(filled):
                        mean[filled] = np.add.reduceat(gamma, first[:-1][filled], axis=0) / size[filled, None]
                    best = mean.argmax(axis=1)
                    for k in named.tolist():
                        names[k], scores[k] = crf.labels[best[k]], min(1.0, max(0.0, mean[k, best[k]]))
                        if with_runs:
                            own = gamma[first[k] : first[k + 1]].argmax(axis=1)
                            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
                            runs[k] = [{"start": a, "stop": b, "lang": crf.labels[own[a]]} for a, b in zip(cuts, cuts[1:])]
                    del gamma
                made = [pa.array(names, pa.string()), pa.array(scores)] + ([pa.array(runs, run_type)] if with_runs else [])
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=shape.names)

        yield from chain.from_iterable(map(labelled, batches))  # holds no batch while the next one is read
        trim_worker()

    return wide.mapInArrow(run, shape)


def held_out() -> Column:
    """The rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _learned(docs: DataFrame) -> Model | None:
    learned = sample(docs, ~held_out() & F.col("doc_id").isNotNull())
    return train(learned) if learned else None


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang) with lang_pred and score, learned from its own rows;
    columns of these names are replaced."""
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return predict(docs, _learned(docs)).select(*(field(c).alias(c) for c in kept), "lang_pred", "score")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    predicted = predict(docs.select("doc_id", "text"), _learned(docs))
    return predicted.select(field("doc_id").alias("doc_id"), "lang_pred", "score").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, least_excess: float = LEAST_EXCESS) -> DataFrame:
    """``docs`` without those that have no letter or no clear language; without any
    labelled row no language is known, and all go."""
    model = _learned(docs)
    chance = 1 / len(model.labels) if model else 1.0
    clear = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= chance + least_excess * (1 - chance))
    return from_row(predict(docs, model).where(clear), docs.columns)
