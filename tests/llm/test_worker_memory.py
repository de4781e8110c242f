"""What labelling texts costs a Python worker."""

from __future__ import annotations

import json
import random
import subprocess
import sys
import tracemalloc
import weakref
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from topiloom.llm import bytewise as bw
from topiloom.llm import langid

_WORKER = """
import json, re, sys
from pathlib import Path
import pyarrow as pa
import public_tokenizers
from topiloom.llm import packing

class Docs:
    select = lambda self, *columns: self
    mapInArrow = lambda self, run, schema: run

packing.F = type("F", (), {"col": lambda self, name: self, "cast": lambda self, kind: self})()
anon = lambda: int(re.search(r"\\nAnonymous:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
run = packing.pieces(Docs(), public_tokenizers.path("byte_bpe_50k.json"))
batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words", None])], names=["doc_id", "text"])
sizes = [anon()]
for _ in range(3):
    for out in run(iter([batch])):
        during = anon()
    assert out.column(3).to_pylist()[1] == 1
    sizes.append(anon())
print(json.dumps([during, *sizes]))
"""


def _batch(texts):
    row = pa.StructArray.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    return pa.RecordBatch.from_arrays([row, pa.array([True] * len(texts))], names=["row", "letter"])


def _prediction(spark, monkeypatch, labels):
    """What a worker runs, with a model of so many labels."""
    rng = np.random.default_rng(labels)
    model = langid.Model([f"l{i:03}" for i in range(labels)], rng.normal(0, 0.1, (1 << langid.BITS, labels)).astype(np.float32), rng.normal(0, 0.1, (labels, labels)))
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    return langid.predict(docs, model)


def _words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("labels", [4, 40])
def test_prediction_takes_bounded_memory(spark, monkeypatch, labels):
    rng = random.Random(labels)
    texts = [_words(rng, n) for n in [2_000] * 150 + [1, 20_000, 3]] + ["", "12 !!"]
    run, bw_tables = _prediction(spark, monkeypatch, labels), bw._tables()
    assert bw_tables
    batch = _batch(texts)
    tracemalloc.start()
    names, scores = [], []
    for out in run(iter([batch])):
        names += out.column(1).to_pylist()
        scores += out.column(2).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90e6
    for i in (0, 77, 150, 151, 152, 153, 154):  # each alone is labelled as it is among others
        alone = next(iter(run(iter([_batch([texts[i]])]))))
        assert alone.column(1)[0].as_py() == names[i]
        assert np.isclose(alone.column(2)[0].as_py(), scores[i], rtol=1e-9, atol=1e-12)
    assert names[-2:] == ["und", "und"] and scores[-2:] == [0, 0]


def test_no_batch_is_held_while_the_next_is_read(spark, monkeypatch):
    read = []

    def feed():
        for i in range(4):
            assert not any(r() for r in read)
            batch = _batch([f"some words {i}"] * 3)
            read.append(weakref.ref(batch))
            yield batch
            del batch

    assert sum(out.num_rows for out in _prediction(spark, monkeypatch, 3)(feed())) == 12


def test_slices_copy_no_text():
    whole = pa.array(["x", "ab", "", "cdé", "efgh", "i"] * 40, pa.string())
    unset = pa.array([None, *whole.to_pylist()]).slice(1)  # could hold nulls, as Spark's columns, but holds none
    for column in (whole, whole.slice(3, 100), whole.cast(pa.large_string()), unset):
        low = column.buffers()[2].address
        high = low + column.buffers()[2].size
        assert all(low <= data.ctypes.data <= high for _, data, _ in bw.slices(column, 16))
    for column in (whole, whole.slice(3, 100), pa.array(["a", None, "bcd", None, None, "é"] * 9).slice(1, 40), pa.array([None, None], pa.string()), pa.array([], pa.string()), pa.array(["a", None]).slice(1)):
        found = [(row + k, bytes(data[a:b]).decode()) for row, data, offsets in bw.slices(column, 16) for k, (a, b) in enumerate(zip(offsets, offsets[1:]))]
        assert found == [(i, t or "") for i, t in enumerate(column.to_pylist())]


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_worker_gives_the_vocabulary_back():
    said = subprocess.run([sys.executable, "-c", _WORKER], capture_output=True, text=True, timeout=120, check=True, cwd=Path(__file__).parents[2]).stdout
    during, before, *after = json.loads(said.splitlines()[-1])
    assert during - before > 30  # MB that the vocabulary takes
    assert max(after) - before < 0.6 * (during - before)
