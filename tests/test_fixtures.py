"""Hand-made cases: rules, replies, stop flags, grouping, merging, neighbours, the kernel."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topiloom.config import CatalogConfig
from topiloom.functions import text as tx
from topiloom.operators import catalog, consensus, graph, metrics, models, topics
from topiloom.operators import vectors as vx
from topiloom.operators.leiden import leiden
from topiloom.plans import run
from topiloom.plans.queries import QUERIES
from topiloom.sources import readers, writers

RULES = [
    (29, "police, court", None, "D-fragment", 1),
    (29, "alpha", None, "D-fragment", 2),
    (30, "police, court", None, None, 0),
    (50, "quokka, zebra", None, None, 1),
    (50, "", None, None, 0),
    (7500, "police, court", None, None, 0),
    (7501, "police, court", None, "C", 1),
    (7501, "abc news, afl", None, "D-meta", 2),
    (20, "pm news", None, "D-meta", 2),
    (100, "afl, election, police", None, None, 0),
    (100, "afl, election, police, flood", None, "C", 1),
    (100, "police, court", 1.5, None, 0),
    (100, "police, court", 1.51, "C", 1),
]


def nodes_of(spark, rows):
    return catalog.new_nodes(spark.createDataFrame(rows, "id string, parent string, depth int, size long, keywords string"))


def test_rules(spark):
    rows = [(f"v0_c{i}", None, 0, size, words) for i, (size, words, *_) in enumerate(RULES)]
    spread = spark.createDataFrame([(f"v0_c{i}", r[2]) for i, r in enumerate(RULES)], "id string, mean_pairwise_dist double")
    nodes = nodes_of(spark, rows).drop("mean_pairwise_dist").join(spread, "id")
    scored = {r["id"]: r for r in catalog.score_rules(nodes, 50_000, 1.0, CatalogConfig(enable_r5=True)).collect()}
    for i, (_, _, _, grade, triggered) in enumerate(RULES):
        assert (scored[f"v0_c{i}"]["rule_grade"], scored[f"v0_c{i}"]["triggered"]) == (grade, triggered), RULES[i]


def test_too_large_beats_too_small(spark):
    row = catalog.score_rules(nodes_of(spark, [("v0_c0", None, 0, 20, "police, court")]), 100).first()
    assert (row["rule_grade"], row["triggered"]) == ("C", 2)


@pytest.mark.parametrize("words, n", [("transport", 2), ("bushfire", 2), ("development", 1), ("party", 2)])
def test_domains_by_substring(spark, words, n):
    assert spark.range(1).select(tx.domain_count(F.lit(words))).first()[0] == n


@pytest.mark.parametrize("words, hit", [("thedrum", True), ("theatre drum", False), ("news  exchange", True)])
def test_blacklist(spark, words, hit):
    assert spark.range(1).select(tx.blacklisted(F.lit(words))).first()[0] is hit


def test_domains_by_token(spark):
    assert spark.range(1).select(tx.domain_count(F.lit("transport, party"), "token")).first()[0] == 2
    assert spark.range(1).select(tx.domain_count(F.lit("bushfires"), "token")).first()[0] == 0


REPLIES = [
    ('{"name_zh":"x","grade":"A","action":"keep"}', "A", None, False),
    ('```json\n{"grade":"C"}\n```', "C", None, False),
    ('Sure: {"grade":"D"} done', "D", None, False),
    ('{"grade":"A/B"}', "B", "A/B", False),
    ('{"name_zh":"x"}', "B", None, False),
    ("no json", "B", None, True),
    ("{bad}", "B", None, True),
]


def test_replies(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(REPLIES)], "i int, reply string")
    for r in df.select("i", tx.parsed_judgement(F.col("reply")).alias("j")).collect():
        assert (r["j"]["grade"], r["j"]["grade_raw"], r["j"]["failed"]) == REPLIES[r["i"]][1:]
        assert r["j"]["action"] == "keep"


def settled(spark, rows):
    df = spark.createDataFrame(rows, "id string, parent string, depth int, size long, final_grade string, action string, status string")
    base = catalog.new_nodes(df.select("id", "parent", "depth", "size", F.lit("").alias("keywords")))
    return base.drop("final_grade", "action", "status").join(df.select("id", "final_grade", "action", "status"), "id").select(*base.columns)


def test_stop_flags(spark):
    flags = lambda rows: catalog.stop_flags(settled(spark, rows), 100).first()
    none = flags([("v0_c0", None, 0, 5, "D-fragment", "bin_fragment", "binned")])
    assert not none["all_named"] and not none["min_size_ok"]
    assert not flags([("v0_c0", None, 0, 15, "B", "accept", "accepted")])["max_topic_ok"]
    assert flags([("v0_c0", None, 0, 14, "B", "accept", "accepted")])["min_size_ok"] is False
    ok = flags([("v0_c0", None, 0, 15, "B", "accept", "accepted"), ("v0_c1", None, 0, 10, "D", "reject", "binned")])
    assert ok["min_size_ok"] and not ok["cd_ratio_ok"]


def test_accounting(spark):
    nodes = settled(
        spark,
        [
            ("v0_c0", None, 0, 50, "C", "split_done", "split"),
            ("v1_c0", "v0_c0", 1, 46, "B", "accept", "accepted"),  # four members were dropped
            ("v0_c1", None, 0, 30, "B", "accept", "accepted"),  # has a child, so it is no leaf
            ("v0_c2", "v0_c1", 1, 10, "B", "accept", "accepted"),
            ("v0_c3", None, 0, 10, "D", "reject", "binned"),
        ],
    )
    s = catalog.catalog_summary(nodes, 100).first()
    assert (s["accepted_headlines"], s["binned_headlines"], s["unaccounted"]) == (56, 10, 34)
    assert {r["bucket"] for r in catalog.bucket_rows(nodes).collect()} == {"rejected"}
    tree = writers.tree_json(catalog.tree_edges(nodes))
    assert tree["meta"]["root_groups"] == 2 and tree["tree"][0]["children"][0]["id"] == "v1_c0"


def test_greedy_groups():
    size = {"v0_c10": 100, "v0_c2": 20, "v0_c3": 35, "v0_c4": 10}
    sim = {("v0_c10", "v0_c2"): 0.9, ("v0_c10", "v0_c3"): 0.9, ("v0_c10", "v0_c4"): 0.55, ("v0_c2", "v0_c3"): 0.1, ("v0_c2", "v0_c4"): 0.1, ("v0_c3", "v0_c4"): 0.1}
    assert graph.greedy_groups(size, sim) == [("v0_c10", "v0_c2")]  # 0.35 and 0.55 are not enough


def test_reassignment_bounds(spark):
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (2, -1, [0.6, 0.8])]
    docs = spark.createDataFrame(rows, "doc_id long, topic_id int, embedding array<double>")
    new = lambda **k: {r["doc_id"]: r["new_topic_id"] for r in topics.reassigned(docs, **k).collect()}[2]
    assert new(threshold=0.6, inclusive=True) == 0
    assert new(threshold=0.6, inclusive=False) == -1


def test_merge_numbers(spark):
    t = spark.createDataFrame([(i,) for i in range(6)], "topic_id int")
    pairs = spark.createDataFrame([(1, 2), (2, 5)], "a int, b int")
    assert {r[0]: r[1] for r in topics.merge_map(t, pairs).collect()} == {1: 0, 2: 0, 5: 0, 0: 1, 3: 2, 4: 3}


def test_neighbours(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    near = {(r["src"], r["dst"]): r["similarity"] for r in vx.nearest_neighbours(v, 10).collect()}
    assert len(near) == 12 and all(a != b for a, b in near)
    assert near[1, 2] == pytest.approx(1) and near[1, 4] == pytest.approx(-1)
    weights = {(r["src"], r["dst"]): r["weight"] for r in graph.undirected(vx.nearest_neighbours(v, 1)).collect()}
    assert weights[1, 2] == pytest.approx(2)  # mutual: both edges count


def test_blocked_neighbours_equal_broadcast(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    a = {(r[0], r[1]) for r in vx.nearest_neighbours(v, 5).collect()}
    b = {(r[0], r[1]) for r in vx._blocked_neighbours(v, 5, 3).collect()}
    assert a == b


def cliques():
    pairs = [(a + o, b + o) for o in (0, 5) for a in range(5) for b in range(a + 1, 5)] + [(4, 5)]
    src, dst = map(np.array, zip(*pairs))
    return src, dst, np.ones(len(src))


def test_leiden():
    src, dst, w = cliques()
    label = leiden(10, src, dst, w, 1.0)
    assert len(set(label[:5])) == len(set(label[5:])) == 1 and label[0] != label[9]
    assert (label == leiden(10, src, dst, w, 1.0)).all()
    assert len(set(leiden(10, src, dst, w, 0.0))) == 1
    assert (leiden(3, np.zeros(0, int), np.zeros(0, int), np.zeros(0), 1.0) == np.arange(3)).all()


def test_leiden_beats_singletons_and_is_connected():
    rng = np.random.default_rng(5)
    src, dst = rng.integers(0, 60, 200), rng.integers(0, 60, 200)
    keep = src != dst
    src, dst, w = src[keep], dst[keep], np.ones(keep.sum())
    label = leiden(60, src, dst, w, 1.0)
    k = np.bincount(np.concatenate([src, dst]), minlength=60)
    quality = lambda c: 2 * (c[src] == c[dst]).sum() - (np.bincount(c, weights=k) ** 2).sum() / k.sum()
    assert quality(label) > quality(np.arange(60))
    for c in set(label):
        own = set(np.flatnonzero(label == c).tolist())
        seen, stack = set(), [min(own)]
        while stack:
            n = stack.pop()
            if n not in seen:
                seen.add(n)
                stack += [b for a, b in zip(np.append(src, dst), np.append(dst, src)) if a == n and b in own]
        assert seen == own


def test_metrics_by_hand(spark):
    rows = [(0, 0, [0.0, 0.0]), (1, 0, [0.0, 2.0]), (2, 1, [10.0, 0.0]), (3, 1, [10.0, 2.0])]
    d = spark.createDataFrame(rows, "doc_id long, topic_id int, embedding array<double>")
    far = (10 + math.hypot(10, 2)) / 2
    assert metrics.silhouette_euclidean(d).first()[0] == pytest.approx((far - 2) / far)
    assert metrics.calinski_harabasz(d).first()[0] == pytest.approx(100 / (4 / 2))
    assert metrics.davies_bouldin(d).first()[0] == pytest.approx(0.2)
    one = metrics.evaluate(d.withColumn("topic_id", F.lit(0)), "m").first()
    assert math.isnan(one["silhouette"]) and one["n_clusters"] == 1


def test_consensus(spark):
    rows = [(1, 0, 0, 0), (2, 0, 0, 0), (3, 1, -1, 1), (4, 1, -1, 1), (5, 0, -1, 1)]
    d = spark.createDataFrame(rows, "doc_id long, l1 int, l2 int, c int")
    mapping = consensus.consensus_map(d, "c", ["l1", "l2"])
    assert {(r["l1"], r["l2"]): r["c"] for r in mapping.collect()} == {(0, 0): 0, (1, -1): 1}
    assert {r[0]: r[1] for r in consensus.apply_map(d, mapping, "c", ["l1", "l2"]).collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 0}
    strict = consensus.coassociation(d, ["l1", "l2"], {"l2": False}).collect()
    assert {(r["a"], r["b"]): r["agreement"] for r in strict} == {(1, 5): 0.5}


def test_split_of_small_and_whole_nodes(spark):
    rng = np.random.default_rng(2)
    rows = [("a", i, rng.normal(size=4).tolist()) for i in range(9)]
    two = [("b", 100 + i, (np.eye(4)[i % 2] + 0.01 * rng.normal(size=4)).tolist()) for i in range(40)]
    v = spark.createDataFrame(rows + two, "node_id string, doc_id long, embedding array<double>")
    found = catalog.sub_communities(v, CatalogConfig(split_neighbours=5)).toPandas()
    assert set(found[found.node_id == "a"]["sub"]) == {0}
    assert found[found.node_id == "b"]["sub"].nunique() >= 2


def test_linkage_and_density(spark):
    x = np.array([[0.0], [0.1], [5.0], [5.1]])
    d = np.abs(x - x.T)
    for kind in ("average", "complete", "ward"):
        label = models.linkage(d, 2, kind)
        assert label[0] == label[1] != label[2] == label[3]


@pytest.mark.parametrize("name", ["agglomerative_topics", "density_topics", "gsdmm_topics"])
def test_whole_tables_get_topics(spark, name):
    sf = "/root/testdata/sf0.1"
    wanted = spark.read.parquet(f"{sf}/embeddings.parquet")
    if name == "gsdmm_topics":
        wanted = wanted.join(spark.read.parquet(f"{sf}/documents.parquet"), F.col("vec_id") == F.col("doc_id"))
    found = [r["doc_id"] for r in QUERIES[name](spark, sf).collect()]
    assert len(found) > 500
    assert sorted(found) == sorted(r["vec_id"] for r in wanted.select("vec_id").collect())


def test_methods_beyond_one_matrix(spark, monkeypatch):
    monkeypatch.setattr(models, "MATRIX_ROWS", 120)
    monkeypatch.setattr(models, "MICRO_CLUSTERS", 40)
    rng = np.random.default_rng(0)
    x = np.repeat(np.eye(3) * 20, 100, axis=0) + rng.normal(size=(300, 3)) * 0.5
    rows = spark.createDataFrame([(i, v.tolist(), " ".join(rng.choice(list("abcd" if i < 100 else "efgh" if i < 200 else "ijkl"), 12))) for i, v in enumerate(x)], "doc_id long, x array<double>, text string")
    for found in (models.agglomerative(rows.select("doc_id", "x"), 3), models.density(rows.select("doc_id", F.transform("x", lambda v: F.when(v > 10, 20.0).otherwise(0.0)).alias("x"))), models.gsdmm(rows.select("doc_id", "text"), 6)):
        by = dict(found.collect())
        assert sorted(by) == list(range(300))
        for a in range(0, 300, 100):
            own = [by[i] for i in range(a, a + 100)]
            most = max(set(own), key=own.count)
            assert most >= 0 and own.count(most) >= 90
            assert all(by[i] != most for i in range(300) if not a <= i < a + 100)


def test_two_levels_have_noise(spark):
    x = [[0.0, 0.0]] * 20 + [[0.0, 5.0]] * 20 + [[0.0, 40.0]] + [[9999.0, 0.0]] * 20
    rows = spark.createDataFrame(list(enumerate(x)), "doc_id long, embedding array<double>")
    by = {r["doc_id"]: r["l2_topic"] for r in models.two_level(rows, 2).collect()}
    assert sorted(by) == list(range(len(x)))
    assert by[40] == -1 and {by[0], by[20]} == {0, 1}


def test_catalog_run_exports_and_resumes(spark, tmp_path):
    from topiloom.plans.queries import documents, uneven

    docs = uneven(documents(spark, "/root/testdata/sf0.001")).persist()
    store = f"file://{tmp_path}/state"
    tables = run.run_catalog(spark, docs, store, out=str(tmp_path / "out"))
    s = tables["summary"].first()
    assert s["accepted_headlines"] + s["binned_headlines"] + s["unaccounted"] == s["total_headlines"] == docs.count()
    assert (tmp_path / "out" / "tree.json").exists() and (tmp_path / "out" / "catalog.csv").exists()
    again = run.run_catalog(spark, docs, store, from_stage="EXPORT")
    assert sorted(map(tuple, again["catalog"].collect())) == sorted(map(tuple, tables["catalog"].collect()))
    with pytest.raises(ValueError):
        run.run_catalog(spark, docs.drop("embedding"), store)


def test_sources(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.arange(12, dtype=np.float32).reshape(4, 3))
    assert [r["embedding"] for r in readers.npy(spark, str(tmp_path / "x.npy")).orderBy("row").collect()][3] == [9.0, 10.0, 11.0]
    (tmp_path / "h.csv").write_text('publish_date,headline_text\n20030219,"a, b"\nbad,c\n')
    rows = {r["text"]: r["publish_date"] for r in readers.headlines(spark, str(tmp_path / "h.csv")).collect()}
    assert str(rows["a, b"]) == "2003-02-19" and rows["c"] is None
    assert spark.range(1).select(readers.list_literal(F.lit("['a', 'b c']"))).first()[0] == ["a", "b c"]


def test_stream_assignment(spark, tmp_path):
    from topiloom.streaming.assign import assign_stream

    v = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])], "doc_id long, topic_id int, embedding array<double>")
    v.select("doc_id", "embedding").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, embedding array<double>").parquet(str(tmp_path / "in"))
    q = assign_stream(stream, vx.centroids(v)).writeStream.format("memory").queryName("assigned").start()
    q.processAllAvailable()
    q.stop()
    assert {r["doc_id"]: r["topic_id"] for r in spark.table("assigned").collect()} == {0: 0, 1: 1}


def test_an_unfinished_run_exports_what_it_returned(spark, tmp_path):
    """The loop runs out of rounds: its last children are graded, saved and exported alike."""
    rng = np.random.default_rng(1)
    rows = [(i, "alpha beta gamma " * (1 + i % 3), (np.eye(6)[i % 6] + rng.normal(size=6) * 0.05).tolist(), 0) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, embedding array<double>, topic_id int").persist()
    store = f"file://{tmp_path}/state"
    tables = run.run_catalog(spark, docs, store, CatalogConfig(max_rounds=1, auto_accept_depth=9))
    assert tables["nodes"].where("status = 'pending'").count() == 0 and tables["nodes"].count() > 1
    again = run.run_catalog(spark, docs, store, from_stage="EXPORT")
    assert sorted(map(str, again["nodes"].collect())) == sorted(map(str, tables["nodes"].collect()))
    left = {r["doc_id"] for r in tables["dropped"].collect()}
    leaves = {r["doc_id"] for r in tables["membership"].where("node_id like 'v1%'").collect()}
    assert not left & leaves


def test_judge_is_asked_once_for_each_prompt(spark, tmp_path):
    asked = []

    def judge(nodes):
        rows = nodes.collect()
        asked.extend(r["id"] for r in rows)
        told = [(r["id"], "name", "A", "keep", r["keywords"] == "bad" and len(asked) < 5) for r in rows]
        return spark.createDataFrame(told, "id string, name string, grade string, action string, failed boolean")

    nodes = spark.createDataFrame([("a", 10, "x"), ("b", 10, "x"), ("c", 20, "y"), ("d", 5, "bad")], "id string, size long, keywords string")
    cached = catalog.cached_judge(judge, f"file://{tmp_path}/replies")
    first = {r["id"]: r["failed"] for r in cached(nodes).collect()}
    assert first == {"a": False, "b": False, "c": False, "d": True} and sorted(asked) == ["a", "c", "d"]
    asked += ["", ""]
    second = {r["id"]: r["failed"] for r in cached(nodes).collect()}
    assert second == dict.fromkeys("abcd", False) and asked[5:] == ["d"]
    cache = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "node_id string, failed boolean")
    assert sorted(r[0] for r in catalog.without_failed(cache).select("node_id").collect()) == ["b"]
    assert sorted(r[0] for r in catalog.without_failed(cache, spark.createDataFrame([("a",)], "node_id string")).select("node_id").collect()) == ["b", "c"]
    assert len({r[0] for r in nodes.select(catalog.prompt_key(F.col("keywords"))).collect()}) == 3


def test_silhouette_of_given_distances(spark):
    rows = [(0, 0, [0.0]), (1, 0, [0.3]), (2, 1, [0.9]), (3, 1, [0.7]), (4, 2, [0.5])]
    d = spark.createDataFrame(rows, "doc_id long, topic_id int, embedding array<double>")
    pairs = spark.createDataFrame([(a[0], b[0], abs(a[2][0] - b[2][0])) for a in rows for b in rows if a[0] < b[0]], "a long, b long, distance double")
    labels = d.select(F.col("doc_id").alias("id"), "topic_id")
    assert metrics.silhouette_precomputed(pairs, labels).first()[0] == pytest.approx(metrics.silhouette_euclidean(d).first()[0])
    # an id that stands for three equal rows
    copies = d.unionByName(spark.createDataFrame([(10, 0, [0.0]), (11, 0, [0.0])], d.schema))
    weighted = labels.withColumn("n", F.when(F.col("id") == 0, 3).otherwise(1))
    assert metrics.silhouette_precomputed(pairs, weighted).first()[0] == pytest.approx(metrics.silhouette_euclidean(copies).first()[0])
    assert metrics.silhouette_sampled(d, 5).first()[0] == pytest.approx(metrics.silhouette_euclidean(d).first()[0])


def test_consensus_scan(spark):
    rows = [(i, i % 3, i % 3, (i + (i % 10 == 0)) % 3) for i in range(60)]
    labels = spark.createDataFrame(rows, "doc_id long, l1 int, l2 int, l3 int")
    found = {r["n_clusters"]: r for r in consensus.consensus_scan(labels, ["l1", "l2", "l3"], (2, 3)).collect()}
    assert found[3]["silhouette"] > found[2]["silhouette"] and found[3]["median_size"] == 20
    assert topics.choose_consensus(consensus.consensus_scan(labels, ["l1", "l2", "l3"], (2, 3))).first()["n_clusters"] == 3


def test_large_parts_are_parted_further(spark, monkeypatch):
    monkeypatch.setattr(models, "PART_ROWS", 30)
    rng = np.random.default_rng(0)
    x = np.repeat([[0.0, 0], [0, 50], [900, 0]], 40, axis=0) + rng.normal(size=(120, 2)) * 0.1
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    pieces = models._bounded_parts(rows, models.kmeans(rows, 2), 42)
    assert sorted(r[0] for r in pieces.select("doc_id").collect()) == list(range(120))
    assert max(r["count"] for r in pieces.groupBy("l1_topic", "piece").count().collect()) <= 45
    by = {r["doc_id"]: (r["l1_topic"], r["l2_topic"]) for r in models.two_level(rows, 2).collect()}
    assert sorted(by) == list(range(120)) and by[0][0] == by[40][0] != by[80][0]


def test_graph_beyond_the_kernel(spark, monkeypatch):
    src, dst, w = cliques()
    edges = spark.createDataFrame(list(zip(src.tolist(), dst.tolist(), w.tolist())), "src long, dst long, weight double")
    nodes = spark.range(10).select(F.col("id").alias("doc_id"))
    scan = {r["resolution"]: r for r in graph.resolution_scan(edges, nodes, (0.0, 1.0)).collect()}
    assert scan[1.0]["n_topics"] == 2 and scan[0.0]["n_topics"] == 1 and scan[1.0]["modularity"] > 0.4
    monkeypatch.setattr(graph, "KERNEL_EDGES", 3)
    found = graph.communities(edges, nodes).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(10)) and {r["community"] for r in found} <= set(range(10))


def test_composite(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"w{i % 3} z{i % 3} common", (np.eye(8)[i % 3] * 9 + rng.normal(size=8) * 0.2).tolist()) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, embedding array<double>").withColumn("topic_id", F.lit(7))
    moved, words = models.topic_composite(docs, 3)
    assert sorted(r["doc_id"] for r in moved.collect()) == list(range(90))
    assert len({r["topic_id"] for r in words.collect()}) == 3 and {r["rank"] for r in words.collect()} >= {1}


def test_sinks_and_readers(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(25)], "doc_id long, embedding array<double>").repartition(3)
    manifest = writers.npy_vectors(v, f"file://{tmp_path}/npy").collect()
    assert sum(r["rows"] for r in manifest) == 25
    for r in manifest:
        path = r["path"].removeprefix("file://")
        ids, x = np.load(path.replace(".npy", ".ids.npy")), np.load(path)
        assert (x[:, 0] == ids).all() and ids[0] == r["first_id"]
    report = spark.createDataFrame([("é", 1)], "name string, n int")
    writers.csv_report(report, str(tmp_path / "r.csv"), bom=True)
    assert (tmp_path / "r.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    writers.csv_table(report, str(tmp_path / "table"))
    assert readers.csv(spark, str(tmp_path / "table"), "name string, n int").collect() == report.collect()
    assert writers.markdown_report("T", report).splitlines() == ["# T", "", "| name | n |", "|---|---|", "| é | 1 |"]
    writers.json_report(report, str(tmp_path / "s.json"))
    assert readers.json_state(spark, str(tmp_path / "s.json"), "name string, n int").first()["name"] == "é"
    (tmp_path / "i.png").write_bytes(b"abc")
    assert readers.images(spark, str(tmp_path / "i.png")).first()["base64"] == "YWJj"
    assert topics.resolve_column(report.withColumn("headline_text", F.lit("")), ("headline", "text")) == "headline_text"
    assert topics.resolve_column(report, ("title",)) == "name"
    assert spark.range(1).select(tx.cleaned(F.lit("A-b c1"), blank=False)).first()[0] == "ab c"
