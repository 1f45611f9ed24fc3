"""Delimited text files of typed records -> a Graph, and a Graph <-> Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexora.functions.shares import shares
from plexora.operators.graph import Graph
from plexora.sources.schema import EntityType, GraphSchema


def _value(text: Column, kind: T.DataType, separator: str, on_error: str) -> Column:
    if isinstance(kind, T.ArrayType):
        parts = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, f"\\Q{separator}\\E", -1))
        return F.transform(parts, lambda x: _value(x, kind.elementType, separator, on_error))
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BinaryType):
        return text.cast("binary")
    if isinstance(kind, T.BooleanType):
        value = F.when(F.lower(text).isin("1", "true"), True).when(F.lower(text).isin("0", "false"), False)
    else:
        value = text.try_cast(kind)
    if on_error == "zero":
        return F.coalesce(value, F.lit(0).cast(kind))
    if on_error == "drop":
        return value
    said = F.concat(F.lit("not a "), F.lit(kind.simpleString()), F.lit(": "), text)
    return F.when(value.isNull(), F.raise_error(said).cast(kind)).otherwise(value)


def read_records(spark: SparkSession, path: str, entity: EntityType, field_separator: str = "\t", array_separator: str = ",", on_error: str = "fail") -> DataFrame:
    """The records of one type. A line's first field is the type; one empty field at its end is left out.

    on_error: what a field that can't be read does: fail the query, count as zero,
    or drop its record.
    """
    parts = F.split("value", f"\\Q{field_separator}\\E", -1)
    n = len(entity.fields)
    parts = F.when((F.size(parts) == n + 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, n)).otherwise(parts)
    lines = spark.read.text(path).where("value <> ''").select(parts.alias("f")).where(F.col("f")[0] == str(entity.number))
    if on_error == "drop":
        lines = lines.where(F.size("f") == n)
    else:
        wrong = F.concat(F.lit(f"a record of {entity.kind} type {entity.number} has "), F.size("f").cast("string"), F.lit(f" fields, not {n}"))
        lines = lines.withColumn("f", F.when(F.size("f") == n, F.col("f")).otherwise(F.raise_error(wrong).cast("array<string>")))
    cols = [_value(F.col("f")[k], field.dataType, array_separator, on_error).alias(field.name) for k, field in enumerate(entity.struct())]
    out = lines.select(*cols)
    return out.dropna() if on_error == "drop" else out


def read_graph(spark: SparkSession, vertex_path: str, edge_path: str, schema: GraphSchema, **options: str) -> Graph:
    vertices = {e.number: read_records(spark, vertex_path, e, **options) for e in schema.vertices}
    edges = {e.number: read_records(spark, edge_path, e, **options) for e in schema.edges}
    return Graph.of(vertices, edges)


def convert(spark: SparkSession, vertex_path: str, edge_path: str, schema: GraphSchema, output: str, partitions: int | None = None, **options: str) -> None:
    """Text -> the Parquet layout that load_graph reads."""
    write_graph(read_graph(spark, vertex_path, edge_path, schema, **options), output, partitions)


def write_graph(graph: Graph, output: str, partitions: int | None = None) -> None:
    """One folder per type. Rows with near ids or sources stand in one file, so that expansions read few; only a source with many edges has several."""
    for kind, tables, key in (("vertex", graph.vertex_tables, ["id"]), ("edge", graph.edge_tables, ["src", "dst"])):
        for number, df in tables.items():
            df.repartitionByRange(partitions or shares(df), *key).sortWithinPartitions(key[0]).write.mode("overwrite").parquet(f"{output}/{kind}={number}")


def load_graph(spark: SparkSession, path: str, schema: GraphSchema) -> Graph:
    vertices = {e.number: spark.read.schema(e.struct()).parquet(f"{path}/vertex={e.number}") for e in schema.vertices}
    edges = {e.number: spark.read.schema(e.struct()).parquet(f"{path}/edge={e.number}") for e in schema.edges}
    return Graph.of(vertices, edges)
