"""Neighborhood aggregation with given weights: dense, segment and degree-normalised forms, attention, encoders.

Vectors are ARRAY<DOUBLE> columns of a known size; every aggregate is element-wise
with the usual combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexora.functions.vectors import add, dot, each, matvec, relu, scale, unit, zeros


@dataclass(frozen=True)
class Weights:
    """Parameters of an aggregator: own and neighbor matrices, the pool matrix and its bias; None leaves a vector as it is."""

    own: list[list[float]] | None = None
    neighbor: list[list[float]] | None = None
    pool: list[list[float]] | None = None
    pool_bias: list[float] | None = None


def _lin(matrix: list[list[float]] | None, c):  # noqa: ANN001, ANN202
    return matvec(matrix, c) if matrix else F.col(c) if isinstance(c, str) else c


def _reduced(messages: DataFrame, keys: list[str], how: Callable, dim: int) -> DataFrame:
    return messages.groupBy(*keys).agg(each(how, "x", dim).alias("agg"), F.count("*").alias("n"))


def pooled(messages: DataFrame, weights: Weights) -> tuple[DataFrame, int | None]:
    """Messages through the pool layer and relu; the new size, None without a pool matrix."""
    size = len(weights.pool) if weights.pool else None
    x = matvec(weights.pool, "x", weights.pool_bias) if weights.pool else F.col("x")
    return messages.withColumn("x", relu(x)), size


def mean(nodes: DataFrame, messages: DataFrame, dim: int, weights: Weights = Weights(), concat: bool = True) -> DataFrame:
    """nodes(key, x), messages(key, x) -> (key, h): own and mean of the messages, concatenated or summed; without messages the mean is 0."""
    agg = _reduced(messages, ["key"], F.avg, dim)
    both = nodes.join(agg, "key", "left").withColumn("agg", F.coalesce("agg", zeros(dim)))
    own, other = _lin(weights.own, "x"), _lin(weights.neighbor, "agg")
    return both.select("key", (F.concat(own, other) if concat else add(own, other)).alias("h"))


def mean_one_kernel(nodes: DataFrame, messages: DataFrame, dim: int, kernel: list[list[float]], concat: bool = True) -> DataFrame:
    """As mean, with one matrix for what was concatenated or summed."""
    return mean(nodes, messages, dim, Weights(), concat).select("key", matvec(kernel, "h").alias("h"))


def mean_pool(nodes: DataFrame, messages: DataFrame, dim: int, weights: Weights = Weights(), concat: bool = True) -> DataFrame:
    messages, size = pooled(messages, weights)
    return mean(nodes, messages, size or dim, weights, concat)


def max_pool(nodes: DataFrame, messages: DataFrame, dim: int, weights: Weights = Weights(), concat: bool = True) -> DataFrame:
    messages, size = pooled(messages, weights)
    agg = _reduced(messages, ["key"], F.max, size or dim)
    both = nodes.join(agg, "key", "left").withColumn("agg", F.coalesce("agg", zeros(size or dim)))
    own, other = _lin(weights.own, "x"), _lin(weights.neighbor, "agg")
    return both.select("key", (F.concat(own, other) if concat else add(own, other)).alias("h"))


def gcn(nodes: DataFrame, messages: DataFrame, dim: int, weights: Weights = Weights()) -> DataFrame:
    """(own + sum of messages) / (number of messages + 1)."""
    agg = _reduced(messages, ["key"], F.sum, dim)
    both = nodes.join(agg, "key", "left").withColumn("agg", F.coalesce("agg", zeros(dim))).withColumn("n", F.coalesce("n", F.lit(0)))
    both = both.withColumn("m", F.transform(add("x", "agg"), lambda v: v / (F.col("n") + 1)))
    return both.select("key", _lin(weights.neighbor, "m").alias("h"))


AGGREGATORS = {"mean": mean, "meanpool": mean_pool, "maxpool": max_pool, "gcn": gcn}
SPARSE_AGGREGATORS = AGGREGATORS | {"mean-1k": mean_one_kernel, "mean-2k": mean}


def get_aggregator(name: str, sparse: bool = False) -> Callable:
    table = SPARSE_AGGREGATORS if sparse else AGGREGATORS
    if name not in table:
        raise ValueError(f"{name} is no aggregator; there are {sorted(table)}")
    return table[name]


def sage_layer(nodes: DataFrame, links: DataFrame, dim: int, aggregator: str = "mean", weights: Weights = Weights(), activation: str | None = "relu", normalise: bool = False) -> DataFrame:
    """nodes(key, x), links(src, dst, weight): x of dst times the link's weight goes to src -> (key, h)."""
    messages = links.join(nodes.select(F.col("key").alias("dst"), "x"), "dst").select(F.col("src").alias("key"), scale("x", F.coalesce(F.col("weight").cast("double"), F.lit(1.0))).alias("x"))
    out = get_aggregator(aggregator, True)(nodes, messages, dim, weights)
    if activation == "relu":
        out = out.withColumn("h", relu("h"))
    return out.withColumn("h", unit("h")) if normalise else out


def message_passing(nodes: DataFrame, levels: list[DataFrame], layers: list[Callable[[DataFrame, DataFrame], DataFrame]]) -> DataFrame:
    """Layers over bipartite links, deepest first; each gets (nodes, links) and its result is the next one's nodes (key, x)."""
    for links, layer in zip(levels, layers, strict=True):
        nodes = layer(nodes, links).select("key", F.col("h").alias("x"))
    return nodes


def gcn_layer(nodes: DataFrame, links: DataFrame, dim: int, matrix: list[list[float]] | None = None, bias: list[float] | None = None) -> DataFrame:
    """sum over links of deg(src)^-1/2 * weight * deg(dst)^-1/2 * (x of dst through matrix) + bias; degrees are links per src, 1 at least."""
    degree = links.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("deg"))
    nodes = nodes.join(degree, "key", "left").withColumn("deg", F.greatest(F.coalesce("deg", F.lit(1)), F.lit(1)))
    size = len(matrix) if matrix else dim
    sent = nodes.select(F.col("key").alias("dst"), scale(_lin(matrix, "x"), 1 / F.sqrt("deg")).alias("x"))
    messages = links.join(sent, "dst").select(F.col("src").alias("key"), scale("x", F.col("weight").cast("double")).alias("x"))
    agg = _reduced(messages, ["key"], F.sum, size)
    both = nodes.join(agg, "key", "left").withColumn("agg", F.coalesce("agg", zeros(size)))
    h = scale("agg", 1 / F.sqrt("deg"))
    return both.select("key", (add(h, F.array(*map(F.lit, bias))) if bias else h).alias("h"))


def semantic_attention(rows: DataFrame, matrix: list[list[float]], vector: list[float], dim: int) -> DataFrame:
    """rows(id, grp, x) -> (id, h): the groups' vectors weighted by softmax of tanh(x through matrix) . vector."""
    hidden = F.transform(matvec(matrix, "x"), F.tanh)
    return _attended(rows.withColumn("score", dot(hidden, F.array(*map(F.lit, vector)))), ["id"], dim)


def node_attention(rows: DataFrame, own: list[float], other: list[float], dim: int, slope: float = 0.2) -> DataFrame:
    """rows(id, head, x, y): leaky relu of own . x + other . y, softmax over an id's neighbors per head, weighted sum of y -> (id, head, h)."""
    raw = dot("x", F.array(*map(F.lit, own))) + dot("y", F.array(*map(F.lit, other)))
    scored = rows.withColumn("score", F.when(raw > 0, raw).otherwise(raw * slope)).withColumn("x", F.col("y"))
    return _attended(scored, ["id", "head"], dim)


def _attended(scored: DataFrame, keys: list[str], dim: int) -> DataFrame:
    top = F.max("score").over(Window.partitionBy(*keys))
    e = scored.withColumn("e", F.exp(F.col("score") - top))
    sums = e.groupBy(*keys).agg(F.sum("e").alias("_z"), F.array(*[F.sum(F.col("e") * F.col("x")[i]) for i in range(dim)]).alias("_s"))
    return sums.select(*keys, F.transform("_s", lambda v: v / F.col("_z")).alias("h"))


# Encoders


def dense_encoder(rows: DataFrame, column: str, matrix: list[list[float]], bias: list[float] | None = None) -> DataFrame:
    return rows.withColumn(column, matvec(matrix, column, bias))


def embedding_lookup(rows: DataFrame, column: str, table: DataFrame, to: str, dim: int) -> DataFrame:
    """Joins table(key, vector); keys that it lacks get zeros."""
    return rows.join(table.select(F.col("key").alias(column), F.col("vector").alias(to)), column, "left").withColumn(to, F.coalesce(to, zeros(dim)))


def combine_features(rows: DataFrame, columns: list[str], how: str = "concat", matrix: list[list[float]] | None = None, to: str = "x") -> DataFrame:
    """concat: behind each other, perhaps through a matrix; add: element-wise sum of vectors of one size."""
    if how not in ("concat", "add"):
        raise ValueError("features are combined by concat or add")
    if how == "concat":
        value = F.concat(*[F.col(c).cast("array<double>") for c in columns])
    else:
        value = F.col(columns[0]).cast("array<double>")
        for c in columns[1:]:
            value = add(value, F.col(c).cast("array<double>"))
    return rows.withColumn(to, matvec(matrix, value) if matrix else value)


def encode_by_type(rows: DataFrame, label: str, encoders: dict[int, list[list[float]]], column: str = "x") -> DataFrame:
    """Each type's vectors through its own matrix; types without one are an error."""
    value = F.raise_error(F.concat(F.lit("no encoder for type "), F.col(label).cast("string"))).cast("array<double>")
    for number, matrix in encoders.items():
        value = F.when(F.col(label) == number, matvec(matrix, column)).otherwise(value)
    return rows.withColumn(column, value)
