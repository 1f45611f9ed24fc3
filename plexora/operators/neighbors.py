"""Out-neighbors of input vertices: all of them, the heaviest, or weighted samples.

Inputs are rows (pos, id): order and repetitions live in pos, which is unique.
Results are long rows under pos. Vertices without neighbors of the types give no
row, or an error when strict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexora.functions.draws import h60, numbers, picked
from plexora.operators.graph import Graph


def inputs(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ids)), "pos long, id long")


def strictly(found: DataFrame, asked: DataFrame, least: int = 1) -> DataFrame:
    """found, with an error for each input that has fewer than least rows."""
    have = found.groupBy("pos").agg(F.count("*").alias("_k"))
    said = F.concat(F.lit("too few neighbors of "), F.col("id").cast("string"))
    checked = asked.select("pos", "id").join(have, "pos", "left").select("pos", F.when(F.coalesce("_k", F.lit(0)) < least, F.raise_error(said).cast("boolean")).otherwise(True).alias("_ok"))
    return checked.join(found, "pos", "left").where("_ok").drop("_ok")


def full_neighbors(graph: Graph, rows: DataFrame, types: list[int] | None = None, strict: bool = False, keep_missing: bool = False) -> DataFrame:
    """(pos, id, etype, dst, weight, w), one row per edge, repeated ones too; with keep_missing, inputs without edges have one row of nulls."""
    found = rows.join(graph.edges_of(types).withColumnRenamed("src", "id"), "id", "left" if keep_missing else "inner").select(*rows.columns, "etype", "dst", "weight", "w")
    return strictly(found, rows) if strict else found


def neighbor_offsets(graph: Graph, rows: DataFrame, types: list[int] | None = None) -> DataFrame:
    """(pos, id, offset, n) of the flat list of all neighbors in input order; n is the degree, 0 without neighbors."""
    degree = graph.edges_of(types).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    out = rows.join(degree, "id", "left").select("pos", "id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    block = F.floor(F.col("pos") / 100_000)
    # Running sums within blocks of inputs, and over the few blocks: no task sees all rows.
    sums = out.groupBy(block.alias("block")).agg(F.sum("n").alias("s"))
    before = sums.select("block", (F.sum("s").over(Window.orderBy("block")) - F.col("s")).alias("before"))
    own = F.sum("n").over(Window.partitionBy("block").orderBy("pos")) - F.col("n")
    return out.withColumn("block", block).withColumn("own", own).join(before, "block").select("pos", "id", (F.col("own") + F.col("before")).alias("offset"), "n")


def degrees(graph: Graph, types: list[int] | None = None) -> DataFrame:
    return graph.edges_of(types).groupBy("src").agg(F.count("*").alias("degree"))


def topk_neighbors(graph: Graph, rows: DataFrame, types: list[int] | None, k: int, strict: bool = False) -> DataFrame:
    """(pos, id, rank, dst, weight, w) of the k heaviest edges, rank 1 the heaviest; ties by dst, then type."""
    if k < 1:
        raise ValueError("k is at least 1")
    best = F.row_number().over(Window.partitionBy("src").orderBy(F.col("w").desc(), "dst", "etype"))
    top = graph.edges_of(types).withColumn("rank", best).where(F.col("rank") <= k)
    found = rows.join(top.withColumnRenamed("src", "id"), "id").select(*rows.columns, F.col("rank").cast("long").alias("rank"), "dst", "weight", "w")
    return strictly(found, rows, k) if strict else found


def topk_arrays(graph: Graph, rows: DataFrame, types: list[int] | None, k: int) -> DataFrame:
    """(pos, id, dsts, weights) in positional form: ascending by weight."""
    found = topk_neighbors(graph, rows, types, k).groupBy("pos", "id").agg(F.sort_array(F.collect_list(F.struct(-F.col("rank"), "dst", "weight"))).alias("x"))
    return found.select("pos", "id", F.col("x.dst").alias("dsts"), F.col("x.weight").alias("weights"))


def sample_neighbors(graph: Graph, rows: DataFrame, types: list[int] | None, count: int, seed: int = 1, op: str = "neighbor", strict: bool = False) -> DataFrame:
    """(pos, id, k, etype, dst, weight, w): count draws with replacement, in proportion to weight among the types' edges."""
    asked = rows.withColumn("k", F.explode(numbers(count))).withColumn("h", h60(seed, op, F.col("pos"), F.col("k")))
    edges = graph.edges_of(types).withColumnRenamed("src", "id")
    found = picked(asked, edges, ["id"], ["etype", "dst", "w"], asked=rows).select(*rows.columns, "k", "etype", "dst", "weight", "w")
    return strictly(found, rows, count) if strict else found


def sample_neighbors_per_type(graph: Graph, rows: DataFrame, types: list[int] | None, count: int, seed: int = 1) -> DataFrame:
    """(pos, id, etype, k, dst, weight, w): count draws for each type that a vertex has."""
    known = graph.check_types(types, "edge")
    asked = rows.withColumn("etype", F.explode(F.array(*map(F.lit, known)))).withColumn("k", F.explode(numbers(count)))
    asked = asked.withColumn("h", h60(seed, "typed", F.col("pos"), F.col("etype"), F.col("k")))
    edges = graph.edges_of(types).withColumnRenamed("src", "id")
    return picked(asked, edges, ["id", "etype"], ["dst", "w"]).select(*rows.columns, "etype", "k", "dst", "weight", "w")
