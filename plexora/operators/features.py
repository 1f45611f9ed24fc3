"""Attribute lookup for input vertices (pos, id) and edges (pos, etype, src, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexora.functions.shares import shares
from plexora.operators.graph import Graph

BUILT_IN = ("vtype", "etype", "weight")


def _shaped(c: Column, kind: T.DataType, dim: int) -> Column:
    """Scalars are vectors of one; arrays are cut to dim elements and never padded."""
    if not isinstance(kind, T.ArrayType):
        return F.array(c)
    return F.slice(c, 1, dim) if dim > 0 else c


def _looked_up(graph: Graph, kind: str, tables: dict[int, DataFrame], keys: list[str], names: list[str], dims: list[int], types: list[T.DataType] | None, numeric: bool) -> DataFrame:
    label = "vtype" if kind == "vertex" else "etype"
    if len(names) != len(dims):
        raise ValueError("there is one dim per name")
    for k, name in enumerate(names):
        if name in BUILT_IN:
            continue
        found = graph.field_type(kind, name)
        if types and types[k] != found:
            raise ValueError(f"{name} is {found.simpleString()}, not {types[k].simpleString()}")
        inner = found.elementType if isinstance(found, T.ArrayType) else found
        if numeric and isinstance(inner, (T.StringType, T.BinaryType)):
            raise ValueError(f"{name} is not numeric")
    parts = []
    for number, df in tables.items():
        if not any(n in df.columns for n in names if n not in BUILT_IN) and not all(n in BUILT_IN for n in names):
            continue
        df = df if "weight" in df.columns else df.withColumn("weight", F.lit(1.0))
        df = df.drop(label).withColumn(label, F.lit(number).cast("int"))
        cols = []
        for name, dim in zip(names, dims, strict=True):
            kind_of = df.schema[name].dataType if name in df.columns else graph.field_type(kind, name)
            value = F.col(name) if name in df.columns else F.lit(None).cast(kind_of)
            cols.append(_shaped(value, kind_of, dim).alias(f"f_{name}"))
        # The slice stands below the join, so that only what is asked for is moved.
        own = [F.col(x).cast("long").alias(x) for x in keys if x != label] + ([F.col(label)] if label in keys else [])
        parts.append(df.select(*own, *cols))
    return reduce(DataFrame.unionByName, parts)


def vertex_features(graph: Graph, rows: DataFrame, names: list[str], dims: list[int] | None = None, types: list[T.DataType] | None = None, strict: bool = True, numeric: bool = False) -> DataFrame:
    """(pos, id, one array column per name). Strict: an id that is missing or lacks an attribute is an error; else null."""
    table = _looked_up(graph, "vertex", graph.vertex_tables, ["id"], names, dims or [0] * len(names), types, numeric)
    return _answered(rows, table, ["id"], names, strict)


def edge_features(graph: Graph, rows: DataFrame, names: list[str], dims: list[int] | None = None, types: list[T.DataType] | None = None, strict: bool = True, numeric: bool = False) -> DataFrame:
    """(pos, etype, src, dst, one array column per name); of repeated edges one row's attributes."""
    keys = ["src", "dst", "etype"]
    table = _looked_up(graph, "edge", graph.edge_tables, keys, names, dims or [0] * len(names), types, numeric)
    return _answered(rows, table, keys, names, strict)


def _answered(rows: DataFrame, table: DataFrame, keys: list[str], names: list[str], strict: bool) -> DataFrame:
    # Of repeated entities one row counts. No semi join with what is asked for: Spark would push it into each type's table, in one task.
    n = shares(table, rows)
    asked = rows.repartition(n, *keys)
    table = table.repartition(n, *keys).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(f"f_{n}") for n in names]))).where("_n = 1").drop("_n")
    out = asked.join(table, keys, "left")
    cols = []
    for n in names:
        c = F.col(f"f_{n}")
        if strict:
            said = F.concat_ws(" ", F.lit(f"no {n} of"), *[F.col(k).cast("string") for k in keys])
            c = F.when(c.isNull() | F.coalesce(c[0].isNull() & (F.size(c) == 1), F.lit(False)) | (F.size(c) == 0), F.raise_error(said).cast(table.schema[f"f_{n}"].dataType)).otherwise(c)
        cols.append(c.alias(n))
    return out.select(*rows.columns, *cols)


def concatenated(rows: DataFrame, names: list[str], to: str = "features") -> DataFrame:
    """The feature arrays behind each other, as doubles."""
    return rows.withColumn(to, F.concat(*[F.col(n).cast("array<double>") for n in names])).drop(*names)


def unique_features(graph: Graph, rows: DataFrame, names: list[str], dims: list[int] | None = None) -> DataFrame:
    """As vertex_features, but each different id is looked up once and joined back."""
    once = rows.select("id").distinct().withColumn("pos", F.col("id"))
    found = vertex_features(graph, once, names, dims, strict=False).drop("pos")
    return rows.join(found, "id", "left").select(*rows.columns, *names)


def standardised(table: DataFrame, column: str, fit_on: Column, dim: int) -> DataFrame:
    """The vectors with mean 0 and deviation 1 per element over the rows that fit_on picks; a constant element is only centred."""
    at = [F.col(column)[i].cast("double") for i in range(dim)]
    mean = table.where(fit_on).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(at)])
    values = [(c - F.col(f"m{i}")) / F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}")) for i, c in enumerate(at)]
    return table.join(F.broadcast(mean), F.lit(True)).withColumn(column, F.array(*values)).select(*table.columns)  # mean is one row
