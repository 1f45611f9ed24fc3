"""The property graph: a narrow topology of typed, weighted vertices and edges, and a table of attributes per type."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexora.functions.draws import integer_weight
from plexora.functions.shares import shares


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Graph:
    """vertices(vtype, id, weight, w), edges(etype, src, dst, weight, w); w is the integer weight that draws use.

    edges keeps repeated edges; edge_keys has one row per (etype, src, dst).
    """

    vertices: DataFrame
    edges: DataFrame
    vertex_tables: dict[int, DataFrame] = field(default_factory=dict)
    edge_tables: dict[int, DataFrame] = field(default_factory=dict)

    @classmethod
    def of(cls, vertex_tables: dict[int, DataFrame], edge_tables: dict[int, DataFrame], check: bool = True) -> Graph:
        """From a table per type with id (or src and dst), perhaps weight, and attributes.

        With check, of vertices with one id the first type's lightest row stays, and
        edges whose source is no vertex go; destinations are not checked.
        """

        def spine(df: DataFrame, label: str, number: int, keys: list[str]) -> DataFrame:
            if "weight" not in df.columns:
                df = df.withColumn("weight", F.lit(1.0))
            return df.select(F.lit(number).cast("int").alias(label), *[F.col(k).cast("long").alias(k) for k in keys], F.col("weight").cast("double").alias("weight"), integer_weight(df).alias("w"))

        vertices = _union([spine(df, "vtype", k, ["id"]) for k, df in vertex_tables.items()])
        edges = _union([spine(df, "etype", k, ["src", "dst"]) for k, df in edge_tables.items()])
        if check:
            rank = F.row_number().over(Window.partitionBy("id").orderBy("vtype", "w"))
            n = shares(vertices, edges)
            vertices = vertices.repartition(n, "id").withColumn("_k", rank).where("_k = 1").drop("_k")
            edges = edges.repartition(n, "src").join(vertices.select(F.col("id").alias("src")).hint("shuffle_hash"), "src", "left_semi")  # the edges of a source are not sorted, however many there are
            edges = edges.select("etype", "src", "dst", "weight", "w")
        return cls(vertices, edges, vertex_tables, edge_tables)

    def cache(self) -> Graph:
        self.vertices.cache()
        self.edges.cache()
        return self

    @property
    def vertex_types(self) -> list[int]:
        return sorted(self.vertex_tables)

    @property
    def edge_types(self) -> list[int]:
        return sorted(self.edge_tables)

    def check_types(self, types: list[int] | None, of: str) -> list[int]:
        """The distinct types that are meant; none stands for all, unknown ones are an error."""
        known = self.vertex_types if of == "vertex" else self.edge_types
        for t in types or []:
            if t not in known:
                raise ValueError(f"{t} is no {of} type; there are {known}")
        return sorted(set(types)) if types else known

    def edges_of(self, types: list[int] | None) -> DataFrame:
        return self.edges.where(F.col("etype").isin(self.check_types(types, "edge")))

    def edge_keys(self) -> DataFrame:
        """Edges without repetitions; of equal ones the lightest stays."""
        return self.edges.repartition(shares(self.edges), "src", "dst").groupBy("etype", "src", "dst").agg(F.min("weight").alias("weight"), F.min("w").alias("w"))

    # Metadata

    def meta(self) -> DataFrame:
        """One row: vertex_size, edge_size (distinct keys)."""
        v = self.vertices.agg(F.count("*").alias("vertex_size"))
        e = self.edge_keys().agg(F.count("*").alias("edge_size"))
        return v.join(e, F.lit(True))  # one row each

    def counts(self) -> DataFrame:
        """kind, type, n, total_w per vertex and edge type."""
        v = self.vertices.groupBy(F.col("vtype").alias("type")).agg(F.count("*").alias("n"), F.sum("w").alias("total_w")).withColumn("kind", F.lit("vertex"))
        e = self.edge_keys().groupBy(F.col("etype").alias("type")).agg(F.count("*").alias("n"), F.sum("w").alias("total_w")).withColumn("kind", F.lit("edge"))
        return v.unionByName(e).select("kind", "type", "n", "total_w")

    # Construction helpers

    def with_reverse(self, pairs: dict[int, int]) -> Graph:
        """Adds for each edge of type a one of type b the other way, for a: b in pairs."""
        more = [self.edges.where(F.col("etype") == a).select(F.lit(b).cast("int").alias("etype"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "w") for a, b in pairs.items()]
        tables = self.edge_tables | {b: more[k] for k, b in enumerate(pairs.values()) if b not in self.edge_tables}
        return Graph(self.vertices, _union([self.edges, *more]), self.vertex_tables, tables)

    def with_self_loops(self, etype: int, only_missing: bool = True, weight: float = 1.0) -> Graph:
        """Adds (i, i) for every vertex, or for those without an edge of this type."""
        lone = self.vertices
        if only_missing:
            have = self.edges.where(F.col("etype") == etype)
            n = shares(self.vertices, self.edges)
            lone = lone.repartition(n, "id").join(have.select(F.col("src").alias("id")).repartition(n, "id").distinct().withColumn("_have", F.lit(True)), "id", "left").where("_have is null").drop("_have")  # no anti join: Spark would push it into each type's table
        loops = lone.select(F.lit(etype).cast("int").alias("etype"), F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(weight).alias("weight"))
        loops = loops.withColumn("w", integer_weight(loops))
        return Graph(self.vertices, self.edges.unionByName(loops), self.vertex_tables, self.edge_tables | {etype: self.edge_tables.get(etype, loops)})

    def field_type(self, kind: str, name: str) -> T.DataType:
        tables = self.vertex_tables if kind == "vertex" else self.edge_tables
        found = [df.schema[name].dataType for df in tables.values() if name in df.columns]
        if not found:
            raise ValueError(f"no {kind} type has the attribute {name}")
        if len(set(found)) > 1:
            raise ValueError(f"{name} has different types: {sorted(f.simpleString() for f in set(found))}")
        return found[0]
