"""Vertex embeddings from random walks, and forward passes of supervised and unsupervised models with given weights.

Training is Word2Vec of Spark ML over the walks as sentences (hierarchical softmax
instead of sampled negatives).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.operators.metrics import get_loss, get_metric, logits


def train_vertex_embedding(walks: DataFrame, dim: int = 16, window: int = 2, iterations: int = 1, partitions: int = 4, seed: int = 1) -> DataFrame:
    """walks(path) -> (id, embedding)."""
    from pyspark.ml.feature import Word2Vec

    sentences = walks.select(F.transform("path", lambda x: x.cast("string")).alias("words"))
    model = Word2Vec(vectorSize=dim, windowSize=window, maxIter=iterations, numPartitions=partitions, minCount=0, seed=seed, inputCol="words", outputCol="v").fit(sentences)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").cast("long").alias("id"), vector_to_array("vector").alias("embedding"))


class Supervised:
    """encoder: rows -> rows(pos, logits, label); evaluate gives its loss and metrics in one row."""

    def __init__(self, encoder: Callable[[DataFrame], DataFrame], loss: str | Callable = "softmax_cross_entropy", metrics: tuple[str, ...] = ("acc",)) -> None:
        self.encoder, self.loss, self.metrics = encoder, get_loss(loss), [get_metric(m) for m in metrics]

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.encoder(rows)

    def evaluate(self, rows: DataFrame) -> DataFrame:
        out = self.encoder(rows)
        result = self.loss(out)
        for m in self.metrics:
            result = result.join(m(out), F.lit(True))  # one row each
        return result


class Unsupervised:
    """rows(pos, target, context, positive) of vectors; the logit is their product."""

    def __init__(self, loss: str | Callable = "neg_cross_entropy", metrics: tuple[str, ...] = ("mrr",)) -> None:
        self.loss, self.metrics = get_loss(loss), [get_metric(m) for m in metrics]

    def predict(self, rows: DataFrame) -> DataFrame:
        return logits(rows)

    def evaluate(self, rows: DataFrame) -> DataFrame:
        out = logits(rows)
        result = self.loss(out)
        for m in self.metrics:
            result = result.join(m(out), F.lit(True))  # one row each
        return result
