"""Connected components by contraction, for links that never come to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.llm.common import discard, ship, stored

#: Contracted edges of at most this number are settled by one task; it holds them and their nodes.
FEW = 1 << 14


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, to) for the nodes of all edges, by union and find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (x := root(a)) != (y := root(b)):
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "to"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of an undirected edge list; comp is one node of the component.

    Each round every node takes the neighbour (or itself) with the smallest hash
    of that round, and the edges are rewritten between the chosen nodes. The hash
    changes from round to round, so that chains shrink by a constant share as
    stars do, and the number of rounds is logarithmic. The last FEW edges are settled at once. Sums per node are combined
    before the shuffle, so a node that holds a third of all edges is one row per
    task. Self links and repeated links are harmless; no link gives no row.
    """
    edges = stored(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    nodes = stored(ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct().withColumn("comp", F.col("node")), "nodes")
    for turn in range(64):
        left = edges.count()
        if not left:
            return nodes
        if left <= FEW:
            ship(links.sparkSession)
            step = stored(edges.select("a", "b").coalesce(1).mapInArrow(_settled, "a long, to long"), "step")
        else:
            both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
            near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("to"))).alias("m"))
            own = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("to"))
            step = stored(near.select("a", F.least(F.col("m"), own)["to"].alias("to")), "step")
        moved = stored(nodes.join(step, nodes["comp"] == step["a"], "left").select("node", F.coalesce("to", "comp").alias("comp")), "nodes")
        if left <= FEW:
            discard(edges, nodes, step)
            return moved
        to_a, to_b = step.select(F.col("a"), F.col("to").alias("na")), step.select(F.col("a").alias("b"), F.col("to").alias("nb"))
        rest = edges.join(to_a, "a").join(to_b, "b").where(F.col("na") != F.col("nb"))
        rest = stored(rest.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "edges")
        discard(edges, nodes, step)
        edges, nodes = rest, moved
    raise RuntimeError("the components did not settle in 64 rounds")
