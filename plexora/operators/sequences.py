"""Multi-hop samples, random walks and context pairs."""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.functions.draws import h60, numbers, picked, picked_within
from plexora.operators.graph import Graph


def multi_hop(graph: Graph, rows: DataFrame, metapath: list[list[int] | None], fanouts: list[int], seed: int = 1) -> DataFrame:
    """(pos, level, slot, parent, id, weight): level order, children of a node next to each other; the root is slot 0 with weight 1.

    Nodes without a neighbor of a hop's types have no children.
    """
    if not metapath or len(metapath) != len(fanouts):
        raise ValueError("a metapath has one fanout per step")
    def node(level: int, slot, parent, vertex, weight):  # noqa: ANN001, ANN202
        return F.struct(F.lit(level).alias("level"), slot.cast("long").alias("slot"), parent.cast("long").alias("parent"), vertex.alias("id"), weight.cast("double").alias("weight"))

    # One row per deepest node with the nodes above it, so that each hop is drawn once. A node that isn't there (id is
    # null) has one row below; of the rows that share a node, the first child's chain gives it.
    zero, none = F.lit(0), F.lit(None)
    paths = rows.select("pos", "id", F.lit(0).cast("long").alias("slot"), F.array(node(0, zero, none, F.col("id"), F.lit(1.0))).alias("path"), F.array().cast("array<long>").alias("ks"))
    first, width = 0, 1
    for hop, (types, fanout) in enumerate(zip(metapath, fanouts, strict=True), 1):
        k = F.explode(F.when(F.col("id").isNull(), numbers(1)).otherwise(numbers(fanout)))
        asked = paths.withColumn("k", k).withColumn("h", h60(seed, "hop", hop, F.col("pos"), F.col("slot"), F.col("k"))).withColumnRenamed("slot", "parent")
        edges = graph.edges_of(types).select(F.col("src").alias("id"), "etype", "dst", "weight", "w")
        found = picked(asked, edges, ["id"], ["etype", "dst", "w"], how="left")
        next_first = first + width
        slot = (F.lit(next_first) + (F.col("parent") - first) * fanout + F.col("k")).cast("long")
        own = node(hop, slot, F.col("parent"), F.col("dst"), F.col("weight"))
        paths = found.select("pos", F.col("dst").alias("id"), slot.alias("slot"), F.concat("path", F.array(own)).alias("path"), F.concat("ks", F.array("k")).alias("ks"))
        first, width = next_first, width * fanout
    depth = len(fanouts)
    leads = F.filter("path", lambda x: x["id"].isNotNull() & ~F.exists(F.slice(F.col("ks"), x["level"] + 1, F.lit(depth)), lambda k: k > 0))
    return paths.select("pos", F.explode(leads).alias("x")).select("pos", "x.level", "x.slot", "x.parent", "x.id", "x.weight")


def multi_hop_arrays(found: DataFrame) -> DataFrame:
    """(pos, ids, weights), slots in order."""
    x = found.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("slot", "id", "weight"))).alias("x"))
    return x.select("pos", F.col("x.id").alias("ids"), F.col("x.weight").alias("weights"))


def last_level(found: DataFrame, level: int) -> DataFrame:
    return found.where(F.col("level") == level)


def _multipliers(p: float, q: float) -> tuple[int, int, int]:
    """Whole-number factors for a common neighbor, a return and any other step, in the proportion 1 : 1/p : 1/q."""
    fp, fq = 1 / Fraction(p).limit_denominator(1000), 1 / Fraction(q).limit_denominator(1000)
    m = lcm(fp.denominator, fq.denominator)
    return m, int(fp * m), int(fq * m)


def random_walk(graph: Graph, rows: DataFrame, metapath: list[list[int] | None], repetition: int = 1, p: float = 1.0, q: float = 1.0, seed: int = 1) -> DataFrame:
    """(walk, pos, path): repetition walks per input, walk = repetition index * 2**40 + pos; path has len(metapath) + 1 vertices.

    With p or q other than 1 a step after the first weighs edges to neighbors of the
    vertex before (over the step before) by 1, back to that vertex by 1/p, others by
    1/q; the first rule goes before the second. Walks that get stuck give no row.
    """
    if not metapath:
        raise ValueError("a metapath has a step")
    if p <= 0 or q <= 0:
        raise ValueError("p and q are above 0")
    first = rows.withColumn("rep", F.explode(numbers(repetition)))
    walks = first.select((F.col("rep") * F.lit(2**40) + F.col("pos")).alias("walk"), "pos", F.array("id").alias("path"), "id")
    plain = p == 1 and q == 1
    common, back, other = _multipliers(p, q)
    for step, types in enumerate(metapath, 1):
        edges = graph.edges_of(types).withColumnRenamed("src", "id").select("id", "etype", "dst", "w")
        asked = walks.withColumn("h", h60(seed, "walk", step, F.col("walk")))
        if plain or step == 1:
            found = picked(asked, edges, ["id"], ["etype", "dst", "w"])
        else:
            before = F.element_at("path", -2)
            near = graph.edges_of(metapath[step - 2]).select(F.col("src").alias("_t"), F.col("dst").alias("_c")).distinct()
            candidates = asked.join(edges, "id").withColumn("_b", before).join(near, (F.col("_b") == F.col("_t")) & (F.col("dst") == F.col("_c")), "left")
            factor = F.when(F.col("_t").isNotNull(), common).when(F.col("dst") == F.col("_b"), back).otherwise(other)
            candidates = candidates.withColumn("w", F.col("w") * factor).drop("_t", "_c", "_b")
            found = picked_within(candidates, ["walk"], ["etype", "dst", "w"])
        walks = found.select("walk", "pos", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("id"))
    return walks.select("walk", "pos", "path")


def context_pairs(walks: DataFrame, context_size: int) -> DataFrame:
    """(walk, pos, n, target, context): for each position the vertices up to context_size after it, then before it, nearest first."""
    if context_size < 1:
        raise ValueError("the context has a vertex")
    c = F.lit(context_size)

    def of(i):  # noqa: ANN001, ANN202
        size, one = F.size("path"), F.lit(1)
        after = F.when(i < size, F.sequence(i + one, F.least(i + c, size))).otherwise(F.array().cast("array<int>"))
        before = F.when(i > one, F.sequence(i - one, F.greatest(i - c, one), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.concat(after, before), lambda j: F.struct(F.element_at("path", i).alias("target"), F.element_at("path", j).alias("context")))

    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("path")), of))
    return walks.select("walk", "pos", F.posexplode(pairs).alias("n", "x")).select("walk", "pos", F.col("n").cast("long").alias("n"), "x.target", "x.context")
