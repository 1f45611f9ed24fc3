"""Weighted samples of vertices and edges, with replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.functions.draws import h60, numbers, picked
from plexora.functions.shares import shares
from plexora.operators.graph import Graph

#: A type's items are cut into blocks by id; a draw finds its block, then its item there, so no type is sorted in one task.
BLOCKS = 256


def draws(df: DataFrame, count: int, *key: str | int) -> DataFrame:
    """df with k = 0..count-1 and h, the hash of the key, the columns pos-like in df, and k."""
    if count < 1:
        raise ValueError("count is at least 1")
    cols = [F.col(c) for c in df.columns]
    return df.withColumn("k", F.explode(numbers(count))).withColumn("h", h60(*key, *cols, F.col("k")))


def _drawn(groups: DataFrame, types: list[int], label: str, key: str, count: int, seed: int, op: str, rest: str = "", tasks: int = 0) -> DataFrame:
    """(label, k, key, and rest: the place within the group): the draws of each type among groups(label, key, w, n items)."""
    groups = groups.withColumn("block", F.pmod(F.col(key), F.lit(BLOCKS)))
    blocks = groups.groupBy(label, "block").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    zero = F.broadcast(blocks.groupBy(label).agg(((F.sum("w") == 0) & (F.sum("n") > 0)).alias("zero")))  # a row per type, from what blocks reads
    weight = F.when(F.col("zero"), F.col("n")).otherwise(F.col("w"))
    asked = draws(groups.sparkSession.createDataFrame([(t,) for t in types], f"{label} int"), count, seed, op)
    found = picked(asked, blocks.join(zero, label).select(label, "block", weight.alias("w")), [label], ["block"], few="items").drop("w")
    item = h60(seed, op, "item", F.col(label), F.col("k"))
    groups = groups.join(zero, label).select(label, "block", key, weight.alias("w"))
    return picked(found.withColumn("h", item), groups, [label, "block"], [key], few="keys", rest=rest, tasks=tasks).select(label, "k", key, *[c for c in [rest] if c])


def sample_vertices(graph: Graph, types: list[int] | None, count: int, seed: int = 1) -> DataFrame:
    """(vtype, k, id): count draws per type in proportion to weight; without types, count draws from all (vtype -1)."""
    known = graph.check_types(types, "vertex")
    if types:
        return _drawn(graph.vertices.where(F.col("vtype").isin(known)).withColumn("n", F.lit(1)), known, "vtype", "id", count, seed, "vertex")
    return _drawn(graph.vertices.withColumn("vtype", F.lit(-1)).withColumn("n", F.lit(1)), [-1], "vtype", "id", count, seed, "vertex")


def sample_edges(graph: Graph, types: list[int] | None, count: int, seed: int = 1) -> DataFrame:
    """(etype, k, src, dst): count draws per type from the distinct edges; without types from all, with each edge's own type."""
    known = graph.check_types(types, "edge")
    # A draw finds its source by the sums of the sources' edges; then only the edges of drawn sources are put in order.
    n = shares(graph.edges)
    edges = graph.edges.where(F.col("etype").isin(known)).select(F.col("etype").alias("own"), "src", "dst", "w").repartition(n, "src").groupBy("own", "src", "dst").agg(F.min("w").alias("w"))
    edges = edges.withColumn("etype", F.col("own") if types else F.lit(-1))
    sources = edges.groupBy("etype", "src").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    found = _drawn(sources, known if types else [-1], "etype", "src", count, seed, "edge", "h", n)
    edges = edges.join(found.select("src").distinct(), "src")  # no semi join: Spark would push it below what sources reads, too
    return picked(found, edges, ["etype", "src"], ["dst", "own"], tasks=n).select(F.col("own").alias("etype"), "k", "src", "dst")


def negatives(graph: Graph, rows: DataFrame, vertex_type: int, count: int, seed: int = 1) -> DataFrame:
    """rows (with a unique column pos) joined with count vertices each: adds k and negative. True neighbors may be among them."""
    graph.check_types([vertex_type], "vertex")
    items = graph.vertices.where(F.col("vtype") == vertex_type).withColumn("block", F.pmod(F.col("id"), F.lit(BLOCKS))).withColumn("one", F.lit(1))
    blocks = items.groupBy("one", "block").agg(F.sum("w").alias("w"))
    asked = rows.withColumn("k", F.explode(numbers(count))).withColumn("one", F.lit(1)).withColumn("h", h60(seed, "neg", F.col("pos"), F.col("k")))
    found = picked(asked, blocks, ["one"], ["block"], few="items").drop("w")
    item = h60(seed, "neg", "item", F.col("pos"), F.col("k"))
    found = picked(found.withColumn("h", item), items.drop("vtype", "weight"), ["one", "block"], ["id"], few="keys", tasks=shares(rows) * count)
    return found.select(*rows.columns, "k", F.col("id").alias("negative"))
