"""Inputs of training and evaluation: ranges, files, tensors, weighted samples; their pipeline; embedding sinks and statistics."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexora.operators.entity import sample_edges, sample_vertices
from plexora.operators.graph import Graph


def range_dataset(spark: SparkSession, start: int, end: int, step: int = 1) -> DataFrame:
    """(pos, id) of start, start + step, ..., end excluded."""
    if step < 1:
        raise ValueError("step is at least 1")
    return spark.range(max(0, math.ceil((end - start) / step))).select(F.col("id").alias("pos"), (F.col("id") * step + start).alias("id"))


def text_line_dataset(spark: SparkSession, path: str, names: list[str], file_pattern: str | None = None, separator: str = ",", worker: int = 0, workers: int = 1, repeat: int = 1, shuffle_seed: int | None = None) -> DataFrame:
    """Rows of whole numbers: this worker's share by a hash of the row, repeat times, in another order of rows for each seed."""
    reader = spark.read.schema(T.StructType([T.StructField(n, T.LongType()) for n in names])).option("sep", separator).option("mode", "FAILFAST")
    rows = (reader.option("pathGlobFilter", file_pattern) if file_pattern else reader).csv(path)
    if workers > 1:
        rows = rows.where(F.pmod(F.xxhash64(*names), F.lit(workers)) == worker)
    if repeat > 1:
        rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
    return rows.orderBy(*(["epoch"] if repeat > 1 else []), F.xxhash64(*rows.columns, F.lit(shuffle_seed))) if shuffle_seed is not None else rows


def tensor_dataset(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """Rows of in-memory columns, with pos."""
    rows = list(zip(*columns.values(), strict=True))
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], ["pos", *columns])


def vertex_dataset(graph: Graph, types: list[int] | None, batch_size: int, max_id: int | None = None, seed: int = 1, worker: int = 0, workers: int = 1) -> DataFrame:
    """(batch, pos, vtype, id): ceil(max_id / batch_size) / workers batches of weighted samples per type."""
    n = max_id if max_id is not None else graph.vertices.count()
    batches = max(1, math.ceil(n / batch_size) // workers)
    rows = sample_vertices(graph, types, batches * batch_size, seed * workers + worker)
    return rows.select(F.floor(F.col("k") / batch_size).alias("batch"), F.col("k").alias("pos"), "vtype", "id")


def edge_dataset(graph: Graph, types: list[int] | None, batch_size: int, max_id: int | None = None, seed: int = 1, worker: int = 0, workers: int = 1) -> DataFrame:
    """(batch, pos, etype, src, dst)."""
    n = max_id if max_id is not None else graph.edges.count()
    batches = max(1, math.ceil(n / batch_size) // workers)
    rows = sample_edges(graph, types, batches * batch_size, seed * workers + worker)
    return rows.select(F.floor(F.col("k") / batch_size).alias("batch"), F.col("k").alias("pos"), "etype", "src", "dst")


def dataset_pipeline(base: DataFrame, *transforms: Callable[[DataFrame], DataFrame], batch_size: int | None = None, worker: int = 0, workers: int = 1) -> DataFrame:
    """This worker's share of base(pos, ...), numbered in batches, through the transforms. Spark's stages take the place of prefetching."""
    out = base.where(F.pmod("pos", F.lit(workers)) == worker) if workers > 1 else base
    if batch_size:
        out = out.withColumn("batch", F.floor(F.floor(F.col("pos") / workers) / batch_size))
    for t in transforms:
        out = out.transform(t)
    return out


@dataclass
class BaseInputs:
    """Where a trainer takes its data from: functions of a session that give DataFrames; a missing one is an error when it is asked for."""

    train: Callable[[SparkSession], DataFrame] | None = None
    evaluate: Callable[[SparkSession], DataFrame] | None = None
    predict: Callable[[SparkSession], DataFrame] | None = None

    def _data(self, name: str, spark: SparkSession) -> DataFrame:
        if (made := getattr(self, name)) is None:
            raise ValueError(f"these inputs have no {name} data")
        return made(spark)

    def train_data(self, spark: SparkSession) -> DataFrame:
        return self._data("train", spark)

    def evaluate_data(self, spark: SparkSession) -> DataFrame:
        return self._data("evaluate", spark)

    def predict_data(self, spark: SparkSession) -> DataFrame:
        return self._data("predict", spark)


def save_embedding(rows: DataFrame, path: str, key: str = "id", vector: str = "embedding") -> None:
    rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def save_predictions(rows: DataFrame, path: str, save: Callable[[DataFrame, str], None] = save_embedding) -> None:
    save(rows, path)


def statistics(rows: DataFrame, *columns: str, since: int | None = None, order: str = "pos") -> DataFrame:
    """Per column: min, mean, max over all rows, and the mean of rows from since on."""
    recent = F.col(order) >= since if since is not None else F.lit(True)
    return rows.agg(*[f.alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min(c)), ("mean", F.avg(c)), ("max", F.max(c)), ("recent", F.avg(F.when(recent, F.col(c)))))])


def split_ids(graph: Graph, vtype: int) -> DataFrame:
    """The vertex ids of a split that is kept as a vertex type (training, validation or test)."""
    return graph.vertices.where(F.col("vtype") == vtype).select("id")


#: The layouts of converted public graph datasets, vertex types by split and attributes.
LAYOUTS = {
    "cora": {"splits": {"train": 0, "val": 1, "test": 2}, "attrs": ("label", "feature")},
    "citeseer": {"splits": {"train": 0, "val": 1, "test": 2}, "attrs": ("label", "feature")},
    "pubmed": {"splits": {"train": 0, "val": 1, "test": 2}, "attrs": ("label", "feature")},
    "ppi": {"splits": {"val": 0, "test": 1, "train": 2}, "attrs": ("feature1", "feature2")},
}


def evaluation_ids(graph: Graph, dataset: str, split: str = "val") -> DataFrame:
    if dataset not in LAYOUTS:
        raise ValueError(f"{dataset} is no known dataset; there are {sorted(LAYOUTS)}")
    return split_ids(graph, LAYOUTS[dataset]["splits"][split])
