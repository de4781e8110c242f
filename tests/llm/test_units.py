"""Kernels of the corpus operators against plain Python on small and odd inputs."""

from __future__ import annotations

import io
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from topiloom.llm import bytewise as bw
from topiloom.llm import covertree, decontam, langid, licenses, minhash, packing, warc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
text = st.text(alphabet="aAbB zZ09é ß漢\n\t.-_", max_size=60)


def split(texts, table):
    out = []
    for _, data, offsets in bw.slices(pa.array(texts, pa.string()), 40):
        starts, ends, first = bw.words(data, offsets, table)
        h = bw.word_hashes(data, starts, ends)
        for k in range(len(offsets) - 1):
            out.append(([data[starts[i] : ends[i]].tobytes() for i in range(first[k], first[k + 1])], h[first[k] : first[k + 1]].tolist()))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(text, st.none()), max_size=8))
def test_words_equal_the_pattern(texts):
    found = split(texts, bw.ALNUM)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for t, (words, hashes) in zip(texts, found, strict=True):
        wanted = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
        assert [w.decode().translate(lower) for w in words] == wanted
        assert len(hashes) == len(wanted)
    by_word = {}
    for words, hashes in found:
        for w, h in zip(words, hashes):
            assert by_word.setdefault(w.decode().translate(lower), h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_long_words_and_windows():
    long = "x" * 100_000
    texts = [long + " a", "a " + long, "b " * 400_000]
    found = split(texts, bw.SOLID)
    assert found[0][1][0] == found[1][1][1] and found[0][1][1] == found[1][1][0]
    assert len(found[2][1]) == 400_000 and len(set(found[2][1])) == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 7))
def test_winnowing_keeps_a_least_hash_of_every_window(values, w):
    h = np.array(values, dtype=np.uint64)
    keep = decontam.winnow(h, w)
    for a in range(max(0, len(h) - w + 1)):
        part = h[a : a + w]
        assert keep[a : a + w][part == part.min()].all()


def brute_hits(doc: list[str], items: dict[str, list[str]], window: int = 10):
    hit, found = set(), set()
    for name, words in items.items():
        n = min(window, len(words))
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
        for i in range(len(doc) - n + 1):
            if n and tuple(doc[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(name)
    return hit, found


def test_decontamination_equals_brute_force():
    rng = random.Random(4)
    vocabulary = list("abcd")
    items = {str(i): [rng.choice(vocabulary) for _ in range(n)] for i, n in enumerate([1, 2, 3, 5, 9, 10, 11, 14, 25])}
    items["none"] = []
    index = decontam.Index([(i, " ".join(w)) for i, w in items.items()], 10)
    docs = [[rng.choice(vocabulary + ["e"] * 2) for _ in range(rng.randrange(0, 60))] for _ in range(200)]
    docs += [["e"] * 3 + items["8"][4:20] + ["e"], items["7"], []]
    row = 0
    for _, data, offsets in bw.slices(pa.array([" ".join(d) for d in docs]), 500):
        first, found = index.hits(data, offsets)
        for k in range(len(offsets) - 1):
            hit, names = brute_hits(docs[row], items)
            spans = decontam.merge([(a, b) for a, b, _ in found.get(k, [])])
            assert {p for s in spans for p in range(s["start"], s["end"])} == hit
            assert {index.ids[i] for _, _, i in found.get(k, [])} == names
            row += 1
    assert row == len(docs)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    factors = minhash._factors(2 * minhash.KEYS * minhash.ROWS)
    for share in (0.2, 0.5, 0.8, 0.95):
        n = int(2000 * share)
        other = np.concatenate([base[:n], rng.integers(0, 2**63, 2000 - n, dtype=np.uint64)])
        true = n / (4000 - n)
        a, b = (minhash.minhashes(np.unique(x), factors) for x in (base, other))
        assert abs((a == b).mean() - true) < 0.15


def test_shingles():
    sets = list(minhash.shingle_sets(pa.array(["a b c d e f", "A B  C\nd e f", "a b", "a  b", "", None, "   ", "a a a a a a a"])))
    assert sets[0].tolist() == sets[1].tolist() and len(sets[0]) == 2
    assert sets[2].tolist() == sets[3].tolist() and len(sets[2]) == 1
    assert [len(s) for s in sets[4:]] == [0, 0, 0, 1]


def test_token_ids_equal_the_library():
    encoder = packing.Encoder(TOKENIZER)
    library = Tokenizer.from_file(TOKENIZER)  # as it comes
    rng = random.Random(1)
    texts = ["", " ", "don't  you'LL\n\n x", "<|endoftext|> a", "a <|endoftext|> b<|endoftext|>", "<|endof", " " * 11_000 + "x", "漢字かな 12345 ½ ²", "😀😀 é", "a" * 3000, "x " * 300, "\u3000" * 400]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x3000, 0xD000), rng.randrange(0x1F000, 0x20000)])) for _ in range(50)) for _ in range(200)]
    texts += [None, "a" * 600 + " b", "b " + " " * 600, "c"]
    for t, ids in zip(texts, encoder.batch(pa.array(texts, pa.string())), strict=True):
        assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids
    library.encode_special_tokens = True
    plain = packing.Encoder(TOKENIZER, specials_as_text=True)
    assert plain.ids("<|endoftext|> a").tolist() == library.encode("<|endoftext|> a", add_special_tokens=False).ids


def test_long_runs_take_no_quadratic_time():
    encoder = packing.Encoder(TOKENIZER)
    texts = ["x" + " " * 9_999] * 20 + [("x" + " " * 9_999) * 20, "ab" * 100_000]
    began = time.perf_counter()
    assert len(list(encoder.batch(pa.array(texts)))) == 22
    assert time.perf_counter() - began < 5


def packed_bins(rows, limit=20):
    out = packing.pack_group(rows, 0, limit)
    by = {}
    for n, s, o, f in zip(*(out[c].to_pylist() for c in ("length", "sequence_id", "offset", "fill"))):
        by.setdefault(s, []).append((o, n, f))
    for own in by.values():
        own.sort()
        fill = sum(n for _, n, _ in own)
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and fill <= limit
        assert all(f == fill for *_, f in own)
    return out, by


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.randoms())
def test_packing_is_whole_and_tight(sizes, rng):
    rows = pa.table({"doc_id": pa.array(range(len(sizes)), pa.int64()), "piece": pa.array([0] * len(sizes), pa.int32()), "start": pa.array([0] * len(sizes), pa.int64()), "length": pa.array(sizes, pa.int64()), "ids_crc32": pa.array([0] * len(sizes), pa.int64()), "turn": pa.array([rng.randrange(50) for _ in sizes], pa.int64())})
    out, by = packed_bins(rows)
    assert sorted(out["length"].to_pylist()) == sorted(sizes)
    in_turn = packing.best_fit(rows.sort_by([("turn", "ascending"), ("doc_id", "ascending")])["length"].to_numpy(), 20)
    assert len(by) <= len(in_turn)
    # a second round starts from the places of the first
    again, later = packed_bins(out.drop_columns(["fill"]))
    assert len(later) <= len(by) and set(later) <= set(by)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40))
def test_every_step_raises_the_squared_fill(sizes):
    size = np.array(sizes, dtype=np.int32)
    bins = packing.best_fit(size, 32)
    fill = np.array([int(size[b].sum()) for b in bins], dtype=np.int32)
    owner = np.empty(len(size), dtype=np.int64)
    for k, b in enumerate(bins):
        owner[b] = k
    for source in np.argsort(fill, kind="stable").tolist():
        while 0 < fill[source] < 32:
            before = int((fill.astype(int) ** 2).sum())
            if not packing._improve(bins, fill, owner, size, source, 32):
                break
            assert int((fill.astype(int) ** 2).sum()) > before
            assert fill.tolist() == [int(size[b].sum()) for b in bins] and fill.max() <= 32
            assert all(owner[i] == k for k, b in enumerate(bins) for i in b)


def test_local_search_empties_bins():
    bins = packing.local_search([[0, 3], [1], [2]], np.array([6, 5, 5, 4]), 10)
    assert len(bins) == 2
    exchanged = packing.local_search([[0, 1], [2, 3], [4]], np.array([6, 3, 5, 4, 2]), 10)
    assert sorted(i for b in exchanged for i in b) == [0, 1, 2, 3, 4] and len(exchanged) == 2
    rng = np.random.default_rng(2)
    lengths = rng.integers(100, 1400, 2000)
    start = packing.best_fit(lengths)
    found = packing.local_search(start, lengths)
    least = -(-int(lengths.sum()) // 2048)
    # it is the search that comes near the bound, not the first packing
    assert len(found) <= least + 2 and len(start) - len(found) >= 5 * (len(found) - least)


def test_pieces_are_full_after_the_first():
    assert packing.piece_lengths(2048) == [2048]
    assert packing.piece_lengths(2049) == [1, 2048]
    assert packing.piece_lengths(6144) == [2048] * 3
    assert packing.piece_lengths(5000) == [904, 2048, 2048]


@pytest.mark.parametrize("n, dense, seed", [(1, 0, 0), (2, 2, 1), (300, 0, 2), (400, 200, 3), (150, 150, 4)])
def test_cover_tree_equals_brute_force(n, dense, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    x[:dense] = x[0] + rng.normal(size=(dense, 16)) * rng.uniform(0.01, 0.2, (dense, 1))
    x *= rng.uniform(0.1, 9, (n, 1))
    norm = np.linalg.norm(x, axis=1)
    weight = rng.integers(1, 4, n)
    linked = (x @ x.T) / np.outer(norm, norm) >= 0.98
    np.fill_diagonal(linked, False)
    tree = covertree.build(x / norm[:, None])
    assert sorted(tree.ids[-1].tolist()) == list(range(n))
    for upper, lower in zip(tree.ids, tree.ids[1:]):
        assert set(upper.tolist()) <= set(lower.tolist())  # nested
    links = covertree.traverse(tree, None, (x, None), (weight, None), 0.98)
    assert links.count.tolist() == (linked * weight[None]).sum(axis=1).tolist()
    third = n // 3
    if third:
        a, b = x[:third], x[third:]
        both = covertree.traverse(covertree.build(a / norm[:third, None]), covertree.build(b / norm[third:, None]), (a, b), (weight[:third], weight[third:]), 0.98)
        across = linked[:third, third:]
        assert both.count.tolist() == [*(across * weight[None, third:]).sum(axis=1), *(across * weight[:third, None]).sum(axis=0)]


def test_multiples_of_a_vector_are_vectors_of_their_own():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 16))
    x[10:20] = x[0] + rng.normal(size=(10, 16)) * 0.03
    x = np.concatenate([x, 2 * x, 0.5 * x[:12], x[:3] * [[4.0], [8.0], [0.25]]])
    for x in (x, x[[0, 40]], x[[0, 40, 80]]):
        n, weight = len(x), rng.integers(1, 4, len(x))
        norm = np.linalg.norm(x, axis=1)
        linked = (x @ x.T) / np.outer(norm, norm) >= 0.98
        np.fill_diagonal(linked, False)
        links = covertree.traverse(covertree.build(x / norm[:, None]), None, (x, None), (weight, None), 0.98)
        assert links.count.tolist() == (linked * weight[None]).sum(axis=1).tolist()
        for i in range(n):
            assert all((links.find(i) == links.find(j)) for j in np.flatnonzero(linked[i]))
        a, b = x[: n // 2], x[n // 2 :]
        both = covertree.traverse(covertree.build(a / norm[: n // 2, None]), covertree.build(b / norm[n // 2 :, None]), (a, b), (weight[: n // 2], weight[n // 2 :]), 0.98)
        across = linked[: n // 2, n // 2 :]
        assert both.count.tolist() == [*(across * weight[None, n // 2 :]).sum(axis=1), *(across * weight[: n // 2, None]).sum(axis=0)]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    emit, move = rng.uniform(0.1, 1, (7, 3)), rng.uniform(0.1, 1, (3, 3))
    first = np.array([0, 4, 4, 7])
    got = langid.posteriors(emit, move, first)
    for a, b in ((0, 4), (4, 7)):
        want = np.zeros((b - a, 3))
        for path in np.ndindex(*([3] * (b - a))):
            p = np.prod([emit[a + i, y] for i, y in enumerate(path)]) * np.prod([move[x, y] for x, y in zip(path, path[1:])])
            for i, y in enumerate(path):
                want[i, y] += p
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True))


def test_code_switching_is_labelled():
    rng = random.Random(2)
    words = {"x": ["shing", "thon", "ning", "the", "and"], "y": ["keit", "ung", "schaft", "der", "und"]}
    make = lambda y, n: " ".join(rng.choice(words[y]) for _ in range(n))
    model = langid.train([(make(y, 80), y) for y in "xy" for _ in range(60)])
    t = make("x", 30) + " " + make("y", 30)
    _, data, offsets = next(bw.slices(pa.array([t])))
    s, e, first = bw.words(data, offsets, bw.ALPHA)
    h = bw.word_hashes(data, s, e)
    gamma = langid.posteriors(langid._softened(model.unary(data, s, e, h)), np.exp(model.moves), first)
    label = [model.labels[i] for i in gamma.argmax(axis=1)]
    assert label == ["x"] * 30 + ["y"] * 30


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 99), st.one_of(st.none(), text), text), max_size=20), st.booleans())
def test_archives_round_trip(rows, with_dictionary):
    trained = warc.dictionary([warc.record(i, None, (f"<html><body>{i} some words that repeat " * 6).encode(), None, False, "") for i in range(64)]) if with_dictionary else b""
    out = io.BytesIO()
    archive = warc.Archive(out, trained)
    for i, url, html in rows:
        archive.add(warc.record(i, url, html.encode(), None, False, warc.digest(html.encode())))
    assert archive.size == len(out.getvalue())
    records = [(f, b) for f, b in warc.read_archive(io.BytesIO(out.getvalue())) if f["WARC-Type"] != "warcinfo"]
    assert [b.partition(b"\r\n\r\n")[2].decode() for _, b in records] == [h for *_, h in rows]
    assert [warc._described(f, b)["page_id"] for f, b in records] == [i for i, *_ in rows]


def test_a_dictionary_leads_the_archive():
    samples = [(f"<html><head><title>page {i}</title></head>" + "<p>text of some length</p>" * (i % 9)).encode() for i in range(200)]
    trained = warc.dictionary(samples)
    assert trained
    out = io.BytesIO()
    warc.Archive(out, trained)
    assert out.getvalue()[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert zlib.crc32(out.getvalue()[8 : 8 + len(trained)]) == zlib.crc32(trained)


NOTICES = {
    "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.": "agpl",
    "licensed under the GNU AGPLv3": "agpl",
    "This file is part of Foo, licensed under the GNU Affero General Public License version 3 or later.": "agpl",
    "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc.": "lgpl",
    "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License. To view a copy visit": "cc-by-nc-sa",
    "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa",
    "This article is published under CC BY-ND 4.0.": "cc-by-nd",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl",
    "// SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT": "mit",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES": "bsd",
    "The code is available under the Apache 2.0 license.": "apache-2.0",
    "This project is licensed under the MIT License - see the LICENSE file for details": "mit",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appears in all copies.": "isc",
    "All contents are made available under the terms of the Eclipse Public License v2.0": "epl",
    "Licensed under the Zope Public License, version 2.1.": "unknown",
    "Released under the Python Software Foundation License": "unknown",
    "Permission is granted to anyone to use this software for any purpose, and to redistribute it freely, provided that this notice stays.": "unknown",
    "Her licence to drive was taken by the court last week.": None,
    "All rights reserved.": None,
    "The book was released in a new version under the old title.": None,
    "The permission to build the house was granted by the town and the public was told.": None,
}


@pytest.fixture(scope="module")
def licence_model():
    rng = random.Random(9)
    prose = [" ".join("".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(3)) for _ in range(30)) for _ in range(300)]
    return licenses.train(prose), prose


def named(model, text):
    h = licenses._hashes(text)
    told = model.judged(h, model.probabilities(h, np.array([0]), np.array([len(h)]))[0])
    return model.families[told[0]] if told else None


def test_licences(licence_model):
    model, prose = licence_model
    templates = [(f, t) for f, own in licenses.TEMPLATES.items() for t, _ in own]
    assert sum(named(model, t) == f for f, t in templates) >= 0.95 * len(templates)
    assert not [t for t in [*licenses.EVERYDAY, *prose] if named(model, t)]
    # notices that are no templates
    right = sum(named(model, t) == f for t, f in NOTICES.items())
    assert right >= 0.9 * len(NOTICES)


def test_licence_scan_equals_brute_force(spark, licence_model):
    model, prose = licence_model
    rng = random.Random(1)
    pieces = [*list(NOTICES)[:20], *prose[:20], "", " * ", "#"]
    texts = ["\n".join(w for _ in range(rng.randrange(0, 12)) for w in [rng.choice(pieces)]) for _ in range(60)] + [None, "", "\n\n", " ".join(prose[:9]) + " " + list(NOTICES)[0]]

    def windows(words):
        n = len(words)
        starts = [0] if n <= licenses.WINDOW_WORDS else range(0, n - licenses.WINDOW_WORDS + licenses.STEP_WORDS, licenses.STEP_WORDS)
        return [words[a : a + licenses.WINDOW_WORDS] for a in starts if n]

    def brute(text):
        found, paragraphs, new = {}, [], True
        lines = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", x) for x in (text or "").split("\n")]
        for k, words in enumerate(lines):
            if k == 0 or (words and not lines[k - 1]):
                paragraphs.append([])
            paragraphs[-1].append(words)
        for k, own in enumerate(paragraphs):
            parts = [w for words in own for w in windows(words)]
            if sum(map(bool, own)) > 1:
                parts += windows([w for words in own for w in words])
            told = {named(model, " ".join(p)) for p in parts} - {None}
            if told - {licenses.UNKNOWN}:
                told -= {licenses.UNKNOWN}
            if told:
                found[k] = told
        return {(k, f) for k, own in found.items() for f in own}

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: {(x["paragraph"], x["family"]) for x in r["licenses"]} for r in licenses.find(docs, model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (i, t)
    assert sum(map(len, got.values())) > 100
