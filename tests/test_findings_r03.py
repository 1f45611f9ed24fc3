"""Findings of round 3: what a task holds and what is moved grow no faster than the input."""

import random

from pyspark.sql import functions as F

from plexora.functions.draws import cumulated, slotted
from plexora.operators import metrics as L
from plexora.operators.entity import negatives, sample_edges
from plexora.operators.features import vertex_features
from plexora.operators.graph import Graph


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def small(spark):
    v = spark.range(40).select("id", (F.col("id") % 3 + 1).alias("weight"))
    e = spark.range(400).selectExpr("id % 20 as src", "(id * 7) % 40 as dst", "id % 4 + 1 as weight")
    return Graph.of({0: v}, {0: e, 1: e})


def test_link_f1_gathers_scores_not_rows(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([None, *range(9)]) if k == "b" else float(rng.randrange(6)), rng.randrange(2) if k != "c" else 0) for k in "aabbc" for _ in range(60)]
    df = spark.createDataFrame([(k, None if s is None else float(s), y) for k, s, y in rows], "key string, score double, label int")
    found = L.link_f1(df, ("key",))

    def brute(mine):
        ranked = sorted(mine, key=lambda r: (r[0] is None, -(r[0] or 0)))
        n = sum(y for _, y in mine)
        floor = ranked[n - 1][0] if n else None
        if floor is None:
            return None
        yes = [y for s, y in mine if s is not None and s >= floor]
        return round(2 * sum(yes) / (len(yes) + n), 12)

    assert {r["key"]: r["f1"] and round(r["f1"], 12) for r in found.collect()} == {k: brute([r[1:] for r in rows if r[0] == k]) for k in "abc"}
    plan = plan_of(found)
    assert plan.rindex("HashAggregate") > plan.rindex("Window")  # a key's scores are counted before anything is ordered


def test_slots_grow_with_the_items(spark):
    """A draw meets PER_SLOT items on average, whatever a key has, and an item is repeated only where a slot begins within it."""
    line = cumulated(spark.range(20_000).selectExpr("1 as g", "id", "id % 9 as w"), ["g"], ["id"])
    slots = slotted(line).groupBy("slot").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert slots[0] <= 24 and slots[1] <= 20_000 * 1.3


def test_shuffles_have_a_task_for_each_share(spark):
    """Spark's coalescing, which gives tasks more with a larger input, leaves a given number of tasks as it is."""
    g = small(spark)
    for df in (g.meta(), g.counts(), g.with_self_loops(0).edges, vertex_features(g, g.vertices.selectExpr("id as pos", "id"), ["vtype"]), sample_edges(g, [0], 5), negatives(g, g.vertices.selectExpr("id as pos"), 0, 2)):
        assert "REPARTITION_BY_NUM" in plan_of(df)
