"""What groups of near-duplicates cost the driver."""

from __future__ import annotations

import random

from topiloom.llm import common, components


def test_steps_are_planned_one_by_one(spark, monkeypatch):
    scans, freed = [], []
    stored = common.Scratch.cut

    def cut(self, df, what, release=False):
        scans.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return stored(self, df, what, release)

    monkeypatch.setattr(common.Scratch, "cut", cut)
    monkeypatch.setattr(common, "release_shuffles", freed.append)
    rng = random.Random(3)
    edges = [(i, rng.randrange(max(0, i - 5), i)) for i in range(1, 60)] + [(100, 101), (102, 101)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(60)} | {i: 100 for i in (100, 101, 102)}
    assert max(scans) <= 12  # both steps in one plan read the edges 50 times
    assert len(freed) == (len(scans) - 1) // 2  # after every round


def test_free_memory_of_the_driver_is_given_back(spark):
    gateway = spark.sparkContext._gateway
    assert common.trim_driver(spark)

    class Plain:  # a JVM without that command
        sparkContext = type("Context", (), {"_gateway": gateway, "_jvm": type("View", (), {"__getattr__": lambda self, name: getattr(gateway.jvm.none, name)})()})()

    assert not common.trim_driver(Plain())
