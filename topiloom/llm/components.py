"""Connected components of an edge table, without collecting any of it.

Alternating large-star and small-star steps (Kiveris et al., "Connected
components in MapReduce and beyond"): each step links neighbours to the least id
among them, so trees flatten to stars in a logarithmic number of rounds.  A hub's
edges meet in partial minima only; its minimum is broadcast to them.

The result of each step is stored: a plan that holds both steps reads the first one
four times over, and planning it, again after each of its stages, costs the driver
memory.  What a round leaves in the driver is given back before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiloom.llm.common import Scratch, hot_rows, with_value


def _with_least(edges: DataFrame, of: DataFrame, rows: int) -> DataFrame:
    """``edges`` with ``_m``: the least neighbour of u in ``of``, or u itself if that is less."""
    least = of.groupBy(F.col("u").alias("_key")).agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n")).select("_key", F.least("_key", "_m").alias("_m"), "_n")
    return with_value(edges, "u", least.drop("_n"), least.where(F.col("_n") > hot_rows(rows)).drop("_n"))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both.where("v > u"), both, rows).select(F.col("v").alias("u"), F.col("_m").alias("v"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    joined = _with_least(down, down, rows)
    return joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("_m").alias("v")), F.struct("u", F.col("_m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the least node of its component.

    Loops and repeated edges are allowed; without edges the result is empty.
    """
    spark = edges.sparkSession
    steps = [Scratch(spark)]
    now = steps[-1].cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    mark, rows = None, now.count()
    for _ in range(max_rounds):
        steps.append(Scratch(spark))
        half = steps[-1].cut(_large_star(now, rows), "half")
        now = steps[-1].cut(_small_star(half, rows).distinct(), "edges", release=True)
        steps.pop(0).drop()
        new_mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == new_mark:
            break
        mark = new_mark
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
