"""The driver's tables as one property graph: id = key * 8 + vertex type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexora.functions.shares import shares
from plexora.operators.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(key: str, vtype: int):  # noqa: ANN202
    return (F.col(key).cast("long") * 8 + vtype).cast("long")


def _cents(c: str):  # noqa: ANN202
    return F.round(F.col(c) * 100).cast("long")


def warehouse_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of a folder's tables; its plan is made once per session and folder."""
    made = spark.__dict__.setdefault("_plexora_graphs", {})
    if sf_dir not in made:
        made[sf_dir] = _warehouse_graph(spark, sf_dir)
    return made[sf_dir]


def _warehouse_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Vertex types: 0 customer, 1 order, 2 part, 3 supplier, 4 nation, 5 region, 6 vector, 7 user.

    Edge types: 0/1 customer-order and back, 2/3 order-part and back (a line item
    each), 4/5 part-supplier and back, 6 customer-nation, 7 supplier-nation,
    8 nation-region, 9 vector to the next five of its label.
    """
    t = {n: table(spark, sf_dir, n) for n in "customer orders part supplier nation region embeddings events lineitem".split()}
    one = F.lit(1).cast("long")
    v = {
        0: t["customer"].withColumn("id", _id("c_custkey", 0)).withColumn("weight", F.round(F.abs("c_acctbal") * 100).cast("long") + 1),
        1: t["orders"].withColumn("id", _id("o_orderkey", 1)).withColumn("weight", _cents("o_totalprice")),
        2: t["part"].withColumn("id", _id("p_partkey", 2)).withColumn("weight", _cents("p_retailprice")),
        3: t["supplier"].withColumn("id", _id("s_suppkey", 3)).withColumn("weight", F.round(F.abs("s_acctbal") * 100).cast("long") + 1),
        4: t["nation"].withColumn("id", _id("n_nationkey", 4)).withColumn("weight", one),
        5: t["region"].withColumn("id", _id("r_regionkey", 5)).withColumn("weight", one),
        6: t["embeddings"].withColumn("id", _id("vec_id", 6)).withColumn("weight", one),
        7: t["events"].groupBy("user_id").agg(F.count("*").alias("weight")).withColumn("id", _id("user_id", 7)),
    }

    def edge(df: DataFrame, src, dst, weight) -> DataFrame:  # noqa: ANN001
        return df.select(src.alias("src"), dst.alias("dst"), weight.alias("weight"))

    def back(df: DataFrame) -> DataFrame:
        return df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")

    placed = edge(t["orders"], _id("o_custkey", 0), _id("o_orderkey", 1), _cents("o_totalprice"))
    items = edge(t["lineitem"], _id("l_orderkey", 1), _id("l_partkey", 2), _cents("l_quantity"))
    lines = t["lineitem"].repartition(shares(t["lineitem"]), "l_partkey", "l_suppkey")  # most of these pairs stand once
    supplied = edge(lines.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")), _id("l_partkey", 2), _id("l_suppkey", 3), F.col("n"))
    e = {
        0: placed,
        1: back(placed),
        2: items,
        3: back(items),
        4: supplied,
        5: back(supplied),
        6: edge(t["customer"], _id("c_custkey", 0), _id("c_nationkey", 4), one),
        7: edge(t["supplier"], _id("s_suppkey", 3), _id("s_nationkey", 4), one),
        8: edge(t["nation"], _id("n_nationkey", 4), _id("n_regionkey", 5), one),
        9: _next_of_label(t["embeddings"]),
    }
    return Graph.of(v, e, check=False)


def _next_of_label(vectors: DataFrame) -> DataFrame:
    ranked = vectors.select("vec_id", "label").selectExpr("vec_id", "label", "row_number() over (partition by label order by vec_id) as n")
    ahead = ranked.selectExpr("vec_id as to", "label", "explode(sequence(n - 5, n - 1)) as n")
    return ranked.join(ahead, ["label", "n"]).select(_id("vec_id", 6).alias("src"), _id("to", 6).alias("dst"), F.lit(1).cast("long").alias("weight"))
