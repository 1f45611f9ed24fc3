"""Endless samples and expansions of streams of vertex ids against a static graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexora.functions.draws import cumulated, h60, slot_of, slotted
from plexora.operators.graph import Graph


def rate_inputs(spark: SparkSession, rows_per_second: int = 100) -> DataFrame:
    """An endless stream (pos, ts)."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select(F.col("value").alias("pos"), F.col("timestamp").alias("ts"))


def stream_vertices(graph: Graph, stream: DataFrame, vertex_type: int, seed: int = 1) -> DataFrame:
    """One weighted vertex sample per row of stream(pos, ...): stateless, joined with the static line of weights."""
    graph.check_types([vertex_type], "vertex")
    items = graph.vertices.where(F.col("vtype") == vertex_type)
    return _picked(stream.withColumn("one", F.lit(1)), items.withColumn("one", F.lit(1)), "one", ["id"], h60(seed, "stream", F.col("pos"))).select(*stream.columns, "id")


def stream_neighbors(graph: Graph, stream: DataFrame, types: list[int] | None, seed: int = 1) -> DataFrame:
    """One sampled neighbor per row of stream(pos, id, ...)."""
    edges = graph.edges_of(types).withColumnRenamed("src", "id").select("id", "etype", "dst", "w")
    return _picked(stream, edges, "id", ["etype", "dst", "w"], h60(seed, "stream", F.col("pos"))).select(*stream.columns, "dst")


def _picked(stream: DataFrame, items: DataFrame, key: str, order: list[str], h) -> DataFrame:  # noqa: ANN001
    line = cumulated(items, [key], order)
    heads = line.groupBy(key).agg(F.first("total").alias("total"), F.first("n_slots").alias("n_slots"))
    asked = stream.join(heads, key).withColumn("r", h % F.col("total"))
    asked = asked.withColumn("slot", slot_of("r")).drop("total", "n_slots")
    return asked.join(slotted(line).drop("total", "n_slots"), [key, "slot"]).where("lo <= r and r < hi")


def degree_updates(stream: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """edges(ts, src, ...) as they come -> edges per source and window of event time; rows later than the delay are left out."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "src").agg(F.count("*").alias("degree")).select(F.col("window.start").alias("start"), "src", "degree")
