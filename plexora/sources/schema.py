"""Graph schemas: a JSON file that declares vertex and edge types, checked and turned into Spark types."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import types as T

#: The type names of a schema file and what they are in Spark.
SCALARS = {
    "DT_BOOL": T.BooleanType(),
    "DT_INT8": T.ByteType(),
    "DT_UINT8": T.ShortType(),
    "DT_INT16": T.ShortType(),
    "DT_UINT16": T.IntegerType(),
    "DT_INT32": T.IntegerType(),
    "DT_UINT32": T.LongType(),
    "DT_INT64": T.LongType(),
    "DT_UINT64": T.DecimalType(20, 0),
    "DT_FLOAT": T.FloatType(),
    "DT_DOUBLE": T.DoubleType(),
    "DT_STRING": T.StringType(),
    "DT_BINARY": T.BinaryType(),
}


class SchemaError(ValueError):
    pass


def spark_type(name: str) -> T.DataType:
    if name in SCALARS:
        return SCALARS[name]
    inner = name.replace("DT_ARRAY_", "DT_", 1)
    if name.startswith("DT_ARRAY_") and inner in SCALARS:
        return T.ArrayType(SCALARS[inner])
    raise SchemaError(f"unknown dtype {name}")


@dataclass(frozen=True)
class EntityType:
    """One vertex or edge type: its number and its fields (name, dtype) in file order."""

    kind: str  # vertex or edge
    number: int
    fields: tuple[tuple[str, str], ...]

    @property
    def keys(self) -> list[str]:
        return ["id"] if self.kind == "vertex" else ["src", "dst"]

    @property
    def attrs(self) -> list[str]:
        return [n for n, _ in self.fields if n not in ("vtype", "etype", "id", "src", "dst", "weight")]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, spark_type(t)) for n, t in self.fields])


@dataclass(frozen=True)
class GraphSchema:
    vertices: tuple[EntityType, ...]
    edges: tuple[EntityType, ...]

    @classmethod
    def load(cls, path: str) -> GraphSchema:
        with open(path) as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, text: str) -> GraphSchema:
        try:
            tree = json.loads(text)
        except ValueError as e:
            raise SchemaError(f"the schema is no JSON: {e}") from e
        if list(tree) != ["vertexes", "edges"]:
            raise SchemaError("a schema has the keys vertexes and edges, in this order")
        return cls(tuple(_entities("vertex", tree["vertexes"])), tuple(_entities("edge", tree["edges"])))


def _entities(kind: str, rows: list[dict]) -> list[EntityType]:
    label, ids = ("vtype", {"entity": "id"}) if kind == "vertex" else ("etype", {"entity_1": "src", "entity_2": "dst"})
    out = []
    for row in rows:
        want = [label, *ids]
        if list(row)[: len(want)] != want:
            raise SchemaError(f"a {kind} type begins with {', '.join(want)}")
        if rest := set(row) - {*want, "weight", "attrs"}:
            raise SchemaError(f"a {kind} type has no field {sorted(rest)[0]}")
        fields = [(label, "DT_UINT8")]
        for name, ours in ids.items():
            if row[name] != "DT_INT64":
                raise SchemaError(f"{name} must be DT_INT64")
            fields.append((ours, row[name]))
        if "weight" in row:
            if row["weight"] not in ("DT_FLOAT", "DT_DOUBLE"):
                raise SchemaError("weight must be DT_FLOAT or DT_DOUBLE")
            fields.append(("weight", row["weight"]))
        for a in row.get("attrs") or []:
            if "name" not in a or "dtype" not in a:
                raise SchemaError("an attribute has a name and a dtype")
            spark_type(a["dtype"])
            fields.append((a["name"], a["dtype"]))
        if len({n for n, _ in fields}) != len(fields):
            raise SchemaError(f"a {kind} type has two fields of one name")
        out.append(EntityType(kind, int(row[label]), tuple(fields)))
    if [e.number for e in out] != list(range(len(out))):
        raise SchemaError(f"{label} numbers start at 0 and have no gaps")
    return out
