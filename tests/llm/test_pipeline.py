"""The pipeline, stage by stage, against plain Python."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_queries import brute_secrets
from topiloom.llm import packing
from topiloom.llm.queries import default_tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [[r.asDict() for r in df.collect()] for df in out]


def words(text):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (text or "").translate(lower), re


def test_columns(stages):
    for rows in stages[:-1]:
        assert set(rows[0]) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_language_stage_keeps_clean_documents(stages):
    before, after = {r["doc_id"]: r for r in stages[0]}, {r["doc_id"] for r in stages[1]}
    gone = [before[i]["text"] for i in before if i not in after]
    assert len(gone) <= 0.01 * len(before)


def test_one_of_each_group_stays(stages):
    shingles = {}
    for r in stages[1]:
        w = words(r["text"])[0].split()
        shingles[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in shingles}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in shingles.items():
        for g in s:
            by[g].append(i)
    pairs = {(a, b) for own in by.values() for a in own for b in own if a < b}
    for a, b in pairs:
        if 100 * len(shingles[a] & shingles[b]) >= 75 * len(shingles[a] | shingles[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert sorted(r["doc_id"] for r in stages[2]) == sorted({find(i) for i in shingles})


def test_contaminated_documents_go(spark, stages):
    lower, re = words("")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = re.findall(pattern, words(r["text"])[0])
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    dirty = lambda t: any(tuple(w[i : i + 10]) in windows for w in [re.findall(pattern, words(t)[0])] for i in range(len(w) - 9))
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(r["doc_id"] for r in stages[2] if not dirty(r["text"]))
    assert len(stages[3]) < len(stages[2])


def test_secrets_are_replaced(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3]}
    assert len(stages[4]) == len(stages[3])
    for r in stages[4]:
        out, at = [], 0
        for a, _, b, _ in brute_secrets(before[r["doc_id"]]):
            if a >= at:
                out += [before[r["doc_id"]][at:a], "[SECRET]"]
            at = max(at, b)
        assert r["text"] == "".join(out) + before[r["doc_id"]][at:]
        assert r["n_chars"] == len(r["text"])


def test_all_tokens_are_packed(stages):
    encoder = packing.Encoder(default_tokenizer())
    want = Counter({r["doc_id"]: len(encoder.reference_ids(r["text"])) + 1 for r in stages[4]})
    got = Counter()
    for r in stages[5]:
        got[r["doc_id"]] += r["length"]
    assert got == want
    used = len({r["sequence_id"] for r in stages[5]})
    assert used <= 1.002 * sum(want.values()) / packing.SEQUENCE + 1


NAMES = ("row", "text_", "id", "hash", "_id", "_hash", "kept", "_kept", "_first", "score", "lang_pred", "runs", "_letter", "letter", "spans", "items", "n_words", "_spans", "_items", "blob", "_blob", "found", "gaps", "chunks", "new", "at", "last", "_salt", "_n", "component", "root", "sid", "stays", "n", "_suspect", "label", "h")
LONG = "the and of to in is that it was for on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will"
SECRET = "then there were two of them and they had said so token=abcdef0123 and more"
ROWS = (
    [(i, f"{LONG} {i} " + " ".join(f"w{i}x{k}" for k in range(60)), "en", "s", 1) for i in range(30)]
    + [(100 + i, "der die das und ist nicht ein eine von mit auf " + " ".join(f"d{i}y{k}" for k in range(60)), "de", "s", 1) for i in range(30)]
    + [
        (200, None, None, None, None),
        (201, "", "en", "s", 0),
        (202, " \n\t", "de", None, 3),
        (None, LONG + " with no id", "en", "s", 9),
        (None, LONG + " with no id", "en", "s", 9),
        (203, LONG * 400, "en", "hot", 9),
        (204, LONG * 400, "en", "hot", 9),
        (205, SECRET, None, "s", 9),
        (205, SECRET, None, "s", 9),
    ]
)


@pytest.fixture(scope="module")
def odd_docs(spark):
    docs = spark.createDataFrame(list(ROWS), "doc_id long, text string, lang string, source string, n_chars long")
    for c in NAMES:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    return docs


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(1, "w3x10 w3x11 w3x12 w3x13 w3x14 w3x15 w3x16 w3x17 w3x18 w3x19"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def gone_and_left(stage, spark, docs, folder):
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, folder)
    if stage == "best_fit_packing":
        return out.collect()
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in NAMES)
    return rows


def test_odd_rows_in_language_id(spark, odd_docs, odd_dir):
    rows = gone_and_left("language_id", spark, odd_docs, odd_dir)
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ROWS if r[0] not in (200, 201, 202))


def test_odd_rows_in_near_dedup(spark, odd_docs, odd_dir):
    rows = gone_and_left("near_dedup", spark, odd_docs, odd_dir)
    want = Counter(r[0] for r in ROWS if r[0] != 204)
    want[205] = 1  # a row that is there twice
    assert Counter(r["doc_id"] for r in rows) == want


def test_odd_rows_in_decontamination(spark, odd_docs, odd_dir):
    rows = gone_and_left("decontamination", spark, odd_docs, odd_dir)
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ROWS if r[0] != 3)


def test_odd_rows_in_secret_scan(spark, odd_docs, odd_dir):
    rows = gone_and_left("secret_scan", spark, odd_docs, odd_dir)
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r[0], r[1] and r[1].replace("token=abcdef0123", "[SECRET]")) for r in ROWS)
    assert {r["n_chars"] for r in rows if r["doc_id"] == 205} == {len(SECRET) - len("token=abcdef0123") + len("[SECRET]")}


def test_odd_rows_in_packing(spark, odd_docs, odd_dir):
    rows = gone_and_left("best_fit_packing", spark, odd_docs, odd_dir)
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r[0] for r in ROWS)
    encoder = packing.Encoder(default_tokenizer())
    assert sum(r["length"] for r in rows) == sum(len(encoder.reference_ids(r[1])) + 1 for r in ROWS)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_empty_tables_in_stages(spark, odd_docs, odd_dir, stage):
    assert not gone_and_left(stage, spark, odd_docs.limit(0), odd_dir)


def test_run_is_the_stages_in_turn(spark, stages):
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert Counter(map(tuple, rows)) == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in stages[5])
