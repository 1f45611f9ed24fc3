"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexora.functions.vectors import cosine
from plexora.operators import messages as M
from plexora.operators import metrics as L
from plexora.operators import transforms as X
from plexora.operators.entity import negatives, sample_edges, sample_vertices
from plexora.operators.features import concatenated, edge_features, standardised, unique_features, vertex_features
from plexora.operators.graph import Graph
from plexora.operators.neighbors import degrees, full_neighbors, neighbor_offsets, sample_neighbors, sample_neighbors_per_type, topk_arrays, topk_neighbors
from plexora.operators.sequences import context_pairs, last_level, multi_hop, multi_hop_arrays, random_walk
from plexora.operators.embedding import Supervised, Unsupervised
from plexora.sources.datasets import dataset_pipeline, edge_dataset, range_dataset, save_embedding, save_predictions, statistics, text_line_dataset, vertex_dataset
from plexora.sources.schema import GraphSchema
from plexora.sources.scratch import scratch
from plexora.sources.tables import table, warehouse_graph
from plexora.sources.text import convert, load_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The graph in SQL, for the CTEs of the oracle queries.
GRAPH = """
vertices AS (
  SELECT 0 AS vtype, c_custkey * 8 AS id, CAST(round(abs(c_acctbal) * 100) AS BIGINT) + 1 AS w FROM customer
  UNION ALL SELECT 1, o_orderkey * 8 + 1, CAST(round(o_totalprice * 100) AS BIGINT) FROM orders
  UNION ALL SELECT 2, p_partkey * 8 + 2, CAST(round(p_retailprice * 100) AS BIGINT) FROM part
  UNION ALL SELECT 3, s_suppkey * 8 + 3, CAST(round(abs(s_acctbal) * 100) AS BIGINT) + 1 FROM supplier
  UNION ALL SELECT 4, CAST(n_nationkey AS BIGINT) * 8 + 4, 1 FROM nation
  UNION ALL SELECT 5, CAST(r_regionkey AS BIGINT) * 8 + 5, 1 FROM region
  UNION ALL SELECT 6, vec_id * 8 + 6, 1 FROM embeddings
  UNION ALL SELECT 7, user_id * 8 + 7, count(*) FROM events GROUP BY user_id),
e0 AS (SELECT o_custkey * 8 AS a, o_orderkey * 8 + 1 AS b, CAST(round(o_totalprice * 100) AS BIGINT) AS w FROM orders),
e2 AS (SELECT l_orderkey * 8 + 1 AS a, l_partkey * 8 + 2 AS b, CAST(round(l_quantity * 100) AS BIGINT) AS w FROM lineitem),
e4 AS (SELECT l_partkey * 8 + 2 AS a, l_suppkey * 8 + 3 AS b, count(*) AS w FROM lineitem GROUP BY 1, 2),
v9 AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
edges AS (
  SELECT 0 AS etype, a AS src, b AS dst, w FROM e0 UNION ALL SELECT 1, b, a, w FROM e0
  UNION ALL SELECT 2, a, b, w FROM e2 UNION ALL SELECT 3, b, a, w FROM e2
  UNION ALL SELECT 4, a, b, w FROM e4 UNION ALL SELECT 5, b, a, w FROM e4
  UNION ALL SELECT 6, c_custkey * 8, CAST(c_nationkey AS BIGINT) * 8 + 4, 1 FROM customer
  UNION ALL SELECT 7, s_suppkey * 8 + 3, CAST(s_nationkey AS BIGINT) * 8 + 4, 1 FROM supplier
  UNION ALL SELECT 8, CAST(n_nationkey AS BIGINT) * 8 + 4, CAST(n_regionkey AS BIGINT) * 8 + 5, 1 FROM nation
  UNION ALL SELECT 9, x.vec_id * 8 + 6, y.vec_id * 8 + 6, 1 FROM v9 x JOIN v9 y ON x.label = y.label AND y.n BETWEEN x.n + 1 AND x.n + 5),
cust AS (SELECT c_custkey AS pos, c_custkey * 8 AS id FROM customer),
vecs AS (SELECT vec_id AS pos, vec_id * 8 + 6 AS id FROM embeddings),
parts AS (SELECT p_partkey AS pos, p_partkey * 8 + 2 AS id FROM part)
"""


def query(sql: str | None = None) -> Callable:
    """Registers a function (graph or spark, sf_dir) under its name; sql begins after the graph's CTEs, or is whole when it says so."""

    def of(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {GRAPH}{sql}"
        return f

    return of


def h(*parts: str) -> str:
    return "CAST(('0x' || substr(md5(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")), 1, 15)) AS BIGINT)"


def line(items: str, keys: str, order: str) -> str:
    """items with lo, hi, total."""
    return f"(SELECT *, CAST(sum(w) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi, CAST(sum(w) OVER (PARTITION BY {keys}) AS BIGINT) AS total FROM {items})"


def pick(draws: str, items: str, key: str, order: str, cols: str) -> str:
    """cols of d (draws with h) and i (items)."""
    return f"SELECT {cols} FROM {draws} d JOIN {line(items, key, order)} i ON d.{key} = i.{key} AND d.h % i.total >= i.hi - i.w AND d.h % i.total < i.hi"


def _edges(types: str) -> str:
    return f"(SELECT etype, src AS id, dst, w FROM edges WHERE etype IN ({types}))"


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), (F.col("c_custkey") * 8).alias("id"))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_partkey") * 8 + 2).alias("id"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), (F.col("vec_id") * 8 + 6).alias("id"))


def graph(spark: SparkSession, sf: str) -> Graph:
    return warehouse_graph(spark, sf)


# Metadata and topology


@query(" SELECT (SELECT count(*) FROM vertices) AS vertex_size, (SELECT count(*) FROM (SELECT DISTINCT etype, src, dst FROM edges)) AS edge_size")
def graph_meta(spark, sf):
    return graph(spark, sf).meta()


@query(""" SELECT 'vertex' AS kind, vtype AS type, count(*) AS n, CAST(sum(w) AS BIGINT) AS total_w FROM vertices GROUP BY vtype
UNION ALL SELECT 'edge', etype, count(*), CAST(sum(w) AS BIGINT) FROM (SELECT etype, src, dst, min(w) AS w FROM edges GROUP BY ALL) GROUP BY etype""")
def type_counts(spark, sf):
    return graph(spark, sf).counts()


@query(" SELECT src, count(*) AS degree FROM edges GROUP BY src")
def degree_all(spark, sf):
    return degrees(graph(spark, sf))


@query(" SELECT src, count(*) AS degree FROM edges WHERE etype = 3 GROUP BY src")
def degree_of_type(spark, sf):
    return degrees(graph(spark, sf), [3])


@query(" SELECT pos, cust.id, etype, dst, w FROM cust JOIN edges ON src = cust.id")
def neighbors_full(spark, sf):
    return full_neighbors(graph(spark, sf), customers(spark, sf)).drop("weight")


@query(" SELECT o_orderkey AS pos, o_orderkey * 8 + 1 AS id, etype, dst, w FROM orders JOIN edges ON src = o_orderkey * 8 + 1 AND etype = 2")
def neighbors_of_type(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") * 8 + 1).alias("id"))
    return full_neighbors(graph(spark, sf), rows, [2, 2]).drop("weight")


@query(""" , n AS (SELECT o_orderkey AS pos, o_orderkey * 8 + 1 AS id, count(src) AS n FROM orders LEFT JOIN edges ON src = o_orderkey * 8 + 1 AND etype = 2 GROUP BY ALL)
SELECT pos, id, CAST(sum(n) OVER (ORDER BY pos) - n AS BIGINT) AS "offset", n FROM n""")
def neighbors_offsets(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") * 8 + 1).alias("id"))
    return neighbor_offsets(graph(spark, sf), rows, [2])


def _topk_sql(k: int, types: str) -> str:
    return f""" SELECT pos, id, rank, dst, w FROM (SELECT pos, cust.id, row_number() OVER (PARTITION BY pos ORDER BY w DESC, dst, etype) AS rank, dst, w
FROM cust JOIN edges ON src = cust.id AND etype IN ({types})) WHERE rank <= {k}"""


@query(_topk_sql(3, "0"))
def topk_orders_per_customer(spark, sf):
    return topk_neighbors(graph(spark, sf), customers(spark, sf), [0], 3).drop("weight")


@query(_topk_sql(1, "0, 6"))
def topk_first(spark, sf):
    return topk_neighbors(graph(spark, sf), customers(spark, sf), [0, 6], 1).drop("weight")


@query(""" , r AS (SELECT p_partkey AS pos, p_partkey * 8 + 2 AS id, row_number() OVER (PARTITION BY p_partkey ORDER BY w DESC, dst, etype) AS rank, dst FROM part JOIN edges ON src = p_partkey * 8 + 2 AND etype IN (3, 4))
SELECT pos, id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY rank DESC) AS dsts FROM r WHERE rank <= 4 GROUP BY pos, id""")
def topk_positional(spark, sf):
    return topk_arrays(graph(spark, sf), parts(spark, sf), [3, 4], 4).select("pos", "id", F.concat_ws(",", F.col("dsts").cast("array<string>")).alias("dsts"))


# Weighted samples


def _entity_sql(items: str, label: str, types: list[int], count: int, op: str, key: str, cols: str, order: str) -> str:
    asked = " UNION ALL ".join(f"SELECT {t} AS {label}" for t in types)
    return f""" , items AS MATERIALIZED (SELECT *, {key} % 256 AS block FROM {items}),
blocks AS (SELECT {label}, block, CAST(sum(w) AS BIGINT) AS w FROM items GROUP BY ALL),
d AS (SELECT {label}, k, {h("1", f"'{op}'", label, "k")} AS h, {h("1", f"'{op}'", "'item'", label, "k")} AS h2 FROM ({asked}), range({count}) t(k)),
b AS ({pick("d", "blocks", label, "block", f"d.{label}, d.k, i.block, d.h2")})
SELECT {cols} FROM b d JOIN {line("items", f"{label}, block", order)} i ON d.{label} = i.{label} AND d.block = i.block AND d.h2 % i.total >= i.hi - i.w AND d.h2 % i.total < i.hi"""


@query(_entity_sql("vertices", "vtype", [0, 1, 2, 3, 4, 5, 6, 7], 1000, "vertex", "id", "d.vtype, d.k, i.id", "id"))
def sample_vertices_by_type(spark, sf):
    return sample_vertices(graph(spark, sf), list(range(8)), 1000)


@query(_entity_sql("(SELECT -1 AS vtype, id, w FROM vertices)", "vtype", [-1], 5000, "vertex", "id", "d.vtype, d.k, i.id", "id"))
def sample_vertices_global(spark, sf):
    return sample_vertices(graph(spark, sf), [], 5000)


_KEYS = "(SELECT etype, src, dst, min(w) AS w FROM edges GROUP BY ALL)"


@query(_entity_sql(_KEYS, "etype", list(range(10)), 500, "edge", "src", "d.etype, d.k, i.src, i.dst", "src, dst"))
def sample_edges_by_type(spark, sf):
    return sample_edges(graph(spark, sf), list(range(10)), 500)


@query(_entity_sql("(SELECT -1 AS etype, etype AS own, src, dst, min(w) AS w FROM edges GROUP BY ALL)", "etype", [-1], 3000, "edge", "src", "i.own AS etype, d.k, i.src, i.dst", "src, dst, own"))
def sample_edges_global(spark, sf):
    return sample_edges(graph(spark, sf), [], 3000)


def _neighbor_sql(rows: str, types: str, count: int, op: str = "neighbor", name: str = "found") -> str:
    return f"""asked_{name} AS (SELECT pos, id, k, {h("1", f"'{op}'", "pos", "k")} AS h FROM {rows}, range({count}) t(k)),
{name} AS ({pick(f"asked_{name}", _edges(types), "id", "etype, dst, w", "d.pos, d.id, d.k, i.etype, i.dst, i.w")})"""


@query(f" , {_neighbor_sql('cust', '0', 5)} SELECT * FROM found")
def sample_neighbors_one_type(spark, sf):
    return sample_neighbors(graph(spark, sf), customers(spark, sf), [0], 5).drop("weight")


@query(f" , {_neighbor_sql('parts', '0, 1, 2, 3, 4, 5, 6, 7, 8, 9', 4)} SELECT * FROM found")
def sample_neighbors_all_types(spark, sf):
    return sample_neighbors(graph(spark, sf), parts(spark, sf), [], 4).drop("weight")


@query(f""" , asked AS (SELECT pos, id, etype, k, {h("1", "'typed'", "pos", "etype", "k")} AS h FROM parts, (SELECT unnest([3, 4]) AS etype), range(3) t(k))
SELECT d.pos, d.id, d.etype, d.k, i.dst, i.w FROM asked d JOIN {line(_edges("3, 4"), "id, etype", "dst, w")} i ON d.id = i.id AND d.etype = i.etype AND d.h % i.total >= i.hi - i.w AND d.h % i.total < i.hi""")
def sample_neighbors_each_type(spark, sf):
    return sample_neighbors_per_type(graph(spark, sf), parts(spark, sf), [3, 4], 3).drop("weight")


# Features


@query(" SELECT p_partkey AS pos, p_partkey * 8 + 2 AS id, p_size, round(p_retailprice, 6) AS price, 2 AS vtype FROM part")
def features_scalar(spark, sf):
    found = vertex_features(graph(spark, sf), parts(spark, sf), ["p_size", "p_retailprice", "vtype"], [1, 1, 1])
    return found.select("pos", "id", F.col("p_size")[0].alias("p_size"), F.round(F.col("p_retailprice")[0], 6).alias("price"), F.col("vtype")[0].alias("vtype"))


@query(" SELECT vec_id AS pos, vec_id * 8 + 6 AS id, 4 AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS x0, round(CAST(embedding[4] AS DOUBLE), 6) AS x3 FROM embeddings")
def features_array_slice(spark, sf):
    found = vertex_features(graph(spark, sf), vectors(spark, sf), ["embedding"], [4])
    x = F.col("embedding")
    return found.select("pos", "id", F.size(x).alias("n"), F.round(x[0].cast("double"), 6).alias("x0"), F.round(x[3].cast("double"), 6).alias("x3"))


@query(" SELECT id AS pos, id, vtype, w FROM vertices")
def features_mixed_types(spark, sf):
    g = graph(spark, sf)
    found = vertex_features(g, g.vertices.select(F.col("id").alias("pos"), "id"), ["vtype", "weight"])
    return found.select("pos", "id", F.col("vtype")[0].alias("vtype"), F.col("weight")[0].alias("w"))


@query(" SELECT o_orderkey AS pos, o_custkey * 8 AS src, o_orderkey * 8 + 1 AS dst, CAST(round(o_totalprice * 100) AS BIGINT) AS w FROM orders")
def features_edge(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), F.lit(0).alias("etype"), (F.col("o_custkey") * 8).alias("src"), (F.col("o_orderkey") * 8 + 1).alias("dst"))
    return edge_features(graph(spark, sf), rows, ["weight"], strict=False).select("pos", "src", "dst", F.col("weight")[0].alias("w"))


@query(" SELECT p_partkey AS pos, round(CAST(p_size AS DOUBLE), 6) AS a, round(p_retailprice, 6) AS b, 2 AS n FROM part")
def features_concat(spark, sf):
    found = concatenated(unique_features(graph(spark, sf), parts(spark, sf), ["p_size", "p_retailprice"]), ["p_size", "p_retailprice"])
    return found.select("pos", F.round(F.col("features")[0], 6).alias("a"), F.round(F.col("features")[1], 6).alias("b"), F.size("features").alias("n"))


@query(""" , v AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings),
s AS (SELECT i, avg(CAST(x AS DOUBLE)) AS m, stddev_pop(CAST(x AS DOUBLE)) AS s FROM v WHERE label < 7 GROUP BY i)
SELECT vec_id, v.i AS i, round((x - m) / s, 5) + 0.0 AS x FROM v JOIN s ON s.i = v.i""")
def features_standardised(spark, sf):
    e = table(spark, sf, "embeddings")
    return standardised(e, "embedding", F.col("label") < 7, 64).select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), (F.round("x", 5) + 0.0).alias("x"))


def vsum(e: str) -> str:
    return f"round(list_sum(list_transform({e}, lambda v: CAST(v AS DOUBLE))), 5) + 0.0"


def _vsum(c):  # noqa: ANN001, ANN202
    return F.round(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double")), 5) + 0.0


# Sequences


def _hop_sql(rows: str, path: list[tuple[str, int]]) -> str:
    ctes, first, width = [f"l0 AS MATERIALIZED (SELECT pos, 0 AS level, CAST(0 AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS parent, id, CAST(0 AS BIGINT) AS w FROM {rows})"], 0, 1
    for hop, (types, fanout) in enumerate(path, 1):
        nxt = first + width
        ctes.append(f"a{hop} AS (SELECT pos, slot, id, k, {h('1', chr(39) + 'hop' + chr(39), str(hop), 'pos', 'slot', 'k')} AS h FROM l{hop - 1}, range({fanout}) t(k))")
        ctes.append(f"l{hop} AS MATERIALIZED ({pick(f'a{hop}', _edges(types), 'id', 'etype, dst, w', f'd.pos, {hop} AS level, CAST({nxt} + (d.slot - {first}) * {fanout} + d.k AS BIGINT) AS slot, d.slot AS parent, i.dst AS id, i.w')})")
        first, width = nxt, width * fanout
    ctes.append("hops AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(len(path) + 1)) + ")")
    return ", ".join(ctes)


_HOPS = [("0", 3), ("2", 2)]


@query(f" , {_hop_sql('cust', _HOPS)} SELECT pos, level, slot, parent, id FROM hops")
def multi_hop_two(spark, sf):
    return multi_hop(graph(spark, sf), customers(spark, sf), [[0], [2]], [3, 2]).drop("weight")


@query(f" , {_hop_sql('cust', [*_HOPS, ('4', 2)])} SELECT pos, string_agg(CAST(id AS VARCHAR), ',' ORDER BY slot) AS ids, CAST(sum(w) AS BIGINT) AS w FROM hops GROUP BY pos")
def multi_hop_three_weighted(spark, sf):
    found = multi_hop_arrays(multi_hop(graph(spark, sf), customers(spark, sf), [[0], [2], [4]], [3, 2, 2]))
    w = F.aggregate("weights", F.lit(0.0), lambda s, v: s + v) - 1
    return found.select("pos", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"), F.round(w).cast("long").alias("w"))


@query(f" , {_hop_sql('cust', _HOPS)} SELECT pos, slot, id FROM hops WHERE level = 2")
def metapath_last_level(spark, sf):
    return last_level(multi_hop(graph(spark, sf), customers(spark, sf), [[0], [2]], [3, 2]), 2).select("pos", "slot", "id")


def _walk_sql(rows: str, steps: list[str], rep: int, factors: tuple[int, int, int] | None = None) -> str:
    ctes = [f"w0 AS (SELECT r * 1099511627776 + pos AS walk, pos, CAST(id AS VARCHAR) AS path, CAST(NULL AS BIGINT) AS before, id FROM {rows}, range({rep}) t(r))"]
    for k, types in enumerate(steps, 1):
        ctes.append(f"x{k} AS MATERIALIZED (SELECT *, {h('1', chr(39) + 'walk' + chr(39), str(k), 'walk')} AS h FROM w{k - 1})")
        cols = "d.walk, d.pos, d.path || ',' || i.dst AS path, d.id AS before, i.dst AS id"
        if factors is None or k == 1:
            ctes.append(f"w{k} AS MATERIALIZED ({pick(f'x{k}', _edges(types), 'id', 'etype, dst, w', cols)})")
        else:
            common, back, other = factors
            near = f"(SELECT DISTINCT src, dst FROM edges WHERE etype IN ({steps[k - 2]}))"
            ctes.append(f"c{k} AS (SELECT x.walk, e.etype, e.dst, e.w * CASE WHEN t.src IS NOT NULL THEN {common} WHEN e.dst = x.before THEN {back} ELSE {other} END AS w FROM x{k} x JOIN {_edges(types)} e ON e.id = x.id LEFT JOIN {near} t ON t.src = x.before AND t.dst = e.dst)")
            ctes.append(f"w{k} AS MATERIALIZED ({pick(f'x{k}', f'c{k}', 'walk', 'etype, dst, w', cols)})")
    return ", ".join(ctes)


def _paths(walks: DataFrame) -> DataFrame:
    return walks.select("walk", "pos", F.concat_ws(",", F.col("path").cast("array<string>")).alias("path"))


@query(f" , {_walk_sql('cust', ['0', '2', '3', '1'], 2)} SELECT walk, pos, path FROM w4")
def random_walk_plain(spark, sf):
    return _paths(random_walk(graph(spark, sf), customers(spark, sf), [[0], [2], [3], [1]], 2))


@query(f" , {_walk_sql('vecs', ['9', '9', '9'], 2, (2, 4, 1))} SELECT walk, pos, path FROM w3")
def random_walk_second_order(spark, sf):
    return _paths(random_walk(graph(spark, sf), vectors(spark, sf), [[9], [9], [9]], 2, p=0.5, q=2.0))


@query(f" , {_walk_sql('cust', ['0', '2', '3'], 1, (2, 4, 1))} SELECT walk, pos, path FROM w3")
def random_walk_return(spark, sf):
    return _paths(random_walk(graph(spark, sf), customers(spark, sf), [[0], [2], [3]], 1, p=0.5, q=2.0))


@query(f""" , {_walk_sql('cust', ['0', '2', '4'], 1)}, v AS (SELECT walk, pos, path, unnest(range(1, 5)) AS i FROM w3),
s AS (SELECT walk, pos, CAST(string_split(path, ',')[i] AS BIGINT) AS v, i FROM v)
SELECT a.walk, a.pos, a.v AS target, b.v AS context, count(*) AS k FROM s a JOIN s b ON a.walk = b.walk AND a.i <> b.i AND abs(a.i - b.i) <= 2 GROUP BY ALL""")
def walk_pairs(spark, sf):
    pairs = context_pairs(random_walk(graph(spark, sf), customers(spark, sf), [[0], [2], [4]]), 2)
    return pairs.groupBy("walk", "pos", "target", "context").agg(F.count("*").alias("k"))


# Negatives and samples for training


def _negative_sql(rows: str, vtype: int, count: int, cols: str) -> str:
    """cols of d (rows with pos) next to k and negative."""
    return f"""neg_items AS MATERIALIZED (SELECT 1 AS one, id % 256 AS block, id, w FROM vertices WHERE vtype = {vtype}), neg_blocks AS (SELECT one, block, CAST(sum(w) AS BIGINT) AS w FROM neg_items GROUP BY ALL),
neg_d AS (SELECT *, 1 AS one, {h("1", "'neg'", "pos", "k")} AS h, {h("1", "'neg'", "'item'", "pos", "k")} AS h2 FROM {rows}, range({count}) t(k)),
neg_b AS ({pick("neg_d", "neg_blocks", "one", "block", "d.*, i.block")}),
negs AS (SELECT {cols}, d.k, i.id AS negative FROM neg_b d JOIN {line("neg_items", "block", "id")} i ON d.block = i.block AND d.h2 % i.total >= i.hi - i.w AND d.h2 % i.total < i.hi)"""


@query(f""" , r AS (SELECT o_orderkey AS pos, o_custkey * 8 AS target, o_orderkey * 8 + 1 AS context FROM orders), {_negative_sql("r", 1, 2, "d.pos, d.target, d.context")} SELECT * FROM negs""")
def edge_negatives(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") * 8).alias("src"), (F.col("o_orderkey") * 8 + 1).alias("dst"))
    return X.edge_neg(graph(spark, sf), rows, 1, 2)


_CONTEXT = _neighbor_sql("cust", "0", 1, "context", "near")


@query(f""" , {_CONTEXT}, r AS (SELECT pos, id AS target, dst AS context FROM near), {_negative_sql("r", 1, 3, "d.pos, d.target, d.context")} SELECT * FROM negs""")
def neighbor_negatives(spark, sf):
    return X.neighbor_neg(graph(spark, sf), customers(spark, sf), 1, [0], 3)


@query(f""" , {_walk_sql('cust', ['0', '2'], 1)}, v AS (SELECT walk, string_split(path, ',') AS p FROM w2),
o(n, i, j) AS (VALUES (0, 1, 2), (1, 2, 3), (2, 2, 1), (3, 3, 2)),
r AS (SELECT walk || '/' || n AS pos, walk, CAST(n AS BIGINT) AS n, CAST(p[i] AS BIGINT) AS target, CAST(p[j] AS BIGINT) AS context FROM v, o), {_negative_sql("r", 2, 2, "d.pos, d.walk, d.n, d.target, d.context")} SELECT * FROM negs""")
def random_walk_negatives(spark, sf):
    return X.random_walk_neg(graph(spark, sf), customers(spark, sf), 2, [[0], [2]], 2, 1)


@query(f""" , {_CONTEXT}, r AS (SELECT pos FROM near), {_negative_sql("r", 1, 2, "d.pos")}
SELECT pos, 'target' AS role, CAST(0 AS BIGINT) AS k, id FROM near UNION ALL SELECT pos, 'context', 0, dst FROM near UNION ALL SELECT pos, 'negative', k, negative FROM negs""")
def target_context_negatives(spark, sf):
    return X.target_context_negative(graph(spark, sf), customers(spark, sf), [0], 1, 2)


@query(f""" , {_hop_sql('vecs', [("9", 2), ("9", 2)])} SELECT pos, level, slot, hops.id, {vsum("embedding")} AS x FROM hops JOIN embeddings ON vec_id * 8 + 6 = hops.id""")
def hop_features(spark, sf):
    found = X.multi_hop_features(graph(spark, sf), vectors(spark, sf), [[9], [9]], [2, 2], ["embedding"])
    return found.select("pos", "level", "slot", "id", _vsum("features").alias("x"))


@query(f""" , {_hop_sql('vecs', [("9", 3)])} SELECT pos, slot, hops.id, {vsum("e.embedding")} AS x, r.label FROM hops JOIN embeddings e ON e.vec_id * 8 + 6 = hops.id JOIN embeddings r ON r.vec_id = pos""")
def hop_features_label(spark, sf):
    found = X.multi_hop_feature_label(graph(spark, sf), vectors(spark, sf), [[9]], [3], ["embedding"], "label")
    return found.select("pos", "slot", "id", _vsum("features").alias("x"), F.col("label")[0].alias("label"))


@query(f""" , {_neighbor_sql("vecs", "9", 1, "context", "near")}, r0 AS (SELECT pos FROM near), {_negative_sql("r0", 6, 2, "d.pos")},
roots AS (SELECT pos * 4 + code AS pos, pos AS root, role, k, id FROM (SELECT pos, 0 AS code, 'target' AS role, CAST(0 AS BIGINT) AS k, id FROM near UNION ALL SELECT pos, 1, 'context', 0, dst FROM near UNION ALL SELECT pos, 2 + k, 'negative', k, negative FROM negs)),
rr AS (SELECT pos, id FROM roots), {_hop_sql('rr', [("9", 2)])}
SELECT root, role, k, slot, hops.id, {vsum("embedding")} AS x FROM hops JOIN roots USING (pos) JOIN embeddings ON vec_id * 8 + 6 = hops.id""")
def hop_features_negative(spark, sf):
    found = X.multi_hop_feature_neg(graph(spark, sf), vectors(spark, sf), [[9]], [2], ["embedding"], 6, 2)
    return found.select("root", "role", "k", "slot", "id", _vsum("features").alias("x"))


_UNIQUE = f"""{_hop_sql('vecs', [("9", 2), ("9", 2)])}, firsts AS (SELECT pos // 50 AS batch, id, min(pos * 100 + slot) AS f FROM hops GROUP BY ALL),
numbered AS (SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY f) - 1 AS "index" FROM firsts), indexed AS (SELECT h.pos, h.slot, h.level, h.parent, h.id, h.w, n."index", n.batch FROM hops h JOIN numbered n ON n.id = h.id AND n.batch = h.pos // 50)"""


def _indexed(spark, sf):
    found = multi_hop(graph(spark, sf), vectors(spark, sf), [[9], [9]], [2, 2]).withColumn("batch", F.floor(F.col("pos") / 50))
    return X.unique_index(found, "batch")


@query(f""" , {_UNIQUE} SELECT DISTINCT batch, "index", id FROM indexed""")
def unique_indices(spark, sf):
    return _indexed(spark, sf).select("batch", "index", "id").distinct()


@query(f""" , {_UNIQUE} SELECT DISTINCT batch, "index", i.id, {vsum("embedding")} AS x FROM indexed i JOIN embeddings ON vec_id * 8 + 6 = i.id""")
def sparse_features(spark, sf):
    found = multi_hop(graph(spark, sf), vectors(spark, sf), [[9], [9]], [2, 2]).withColumn("batch", F.floor(F.col("pos") / 50))
    nodes, _ = X.sparse_form(graph(spark, sf), found, ["embedding"], None, "batch")
    return nodes.select("batch", "index", "id", _vsum("features").alias("x"))


@query(f""" , {_UNIQUE} SELECT c.batch, c.pos, p."index" AS parent_index, c."index" AS child_index FROM indexed c JOIN indexed p ON p.pos = c.pos AND p.slot = c.parent""")
def relation_indices(spark, sf):
    return X.relations(_indexed(spark, sf), [2, 2]).select(F.floor(F.col("pos") / 50).alias("batch"), "pos", "parent_index", "child_index")


@query(f""" , {_hop_sql('cust', _HOPS)} SELECT c.pos, c.parent AS src_slot, p.id AS src, c.slot AS dst_slot, c.id AS dst FROM hops c JOIN hops p ON p.pos = c.pos AND p.slot = c.parent""")
def bipartite_levels(spark, sf):
    levels = X.bipartite(multi_hop(graph(spark, sf), customers(spark, sf), [[0], [2]], [3, 2]), 2)
    return levels[0].union(levels[1]).drop("weight")


@query(" SELECT etype AS x, dst AS y, min(src) AS \"index\" FROM edges GROUP BY ALL")
def unique_pairs(spark, sf):
    return X.unique_pair(graph(spark, sf).edges.select(F.col("src").alias("pos"), F.col("etype").alias("x"), F.col("dst").alias("y")))


@query(" SELECT src, dst, w FROM edges WHERE etype = 9 UNION ALL SELECT dst, src, w FROM edges WHERE etype = 9")
def reverse_edges(spark, sf):
    return graph(spark, sf).with_reverse({9: 9}).edges.where("etype = 9").select("src", "dst", "w")


@query(" SELECT id AS src, id AS dst FROM vertices WHERE id NOT IN (SELECT src FROM edges WHERE etype = 2)")
def self_loops(spark, sf):
    return graph(spark, sf).with_self_loops(2).edges.where("etype = 2 and src = dst").select("src", "dst")


# Aggregation over the vectors' graph


DIM = 64  # the whole vector
_X = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(DIM))
_NODES = f"nodes AS (SELECT vec_id * 8 + 6 AS key, {_X} FROM embeddings), links AS (SELECT src, dst, w FROM edges WHERE etype = 9)"


def _nodes(spark, sf):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf, "embeddings").select((F.col("vec_id") * 8 + 6).alias("key"), x.alias("x"))


def _messages(spark, sf):
    links = graph(spark, sf).edges.where("etype = 9")
    return links.join(_nodes(spark, sf).withColumnRenamed("key", "dst"), "dst").select(F.col("src").alias("key"), "x")


def _flat(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    return rows.select(*(keys or ("key",)), *[(F.round(F.col("h")[i], 5) + 0.0).alias(f"h{i}") for i in range(n)])


def _agg_sql(how: str, value: str) -> str:
    sums = ", ".join(f"{how.format(f'o.x{i}')} AS a{i}" for i in range(DIM))
    return f" , {_NODES}, agg AS (SELECT src AS key, {sums}, count(*) AS n FROM links JOIN nodes o ON o.key = dst GROUP BY src) SELECT nodes.key, {value} FROM nodes LEFT JOIN agg USING (key)"


_OWN_AND = ", ".join(f"round(x{i}, 5) AS h{i}" for i in range(DIM)) + ", " + ", ".join(f"round(coalesce(a{i}, 0), 5) AS h{i + DIM}" for i in range(DIM))


@query(_agg_sql("avg({})", _OWN_AND))
def aggregate_mean(spark, sf):
    return _flat(M.mean(_nodes(spark, sf), _messages(spark, sf), DIM), 2 * DIM)


@query(_agg_sql("avg(greatest({}, 0))", _OWN_AND))
def aggregate_mean_pool(spark, sf):
    return _flat(M.mean_pool(_nodes(spark, sf), _messages(spark, sf), DIM), 2 * DIM)


@query(_agg_sql("max(greatest({}, 0))", _OWN_AND))
def aggregate_max_pool(spark, sf):
    return _flat(M.max_pool(_nodes(spark, sf), _messages(spark, sf), DIM), 2 * DIM)


@query(_agg_sql("sum({})", ", ".join(f"round((x{i} + coalesce(a{i}, 0)) / (coalesce(n, 0) + 1), 5) AS h{i}" for i in range(DIM))))
def aggregate_gcn(spark, sf):
    return _flat(M.gcn(_nodes(spark, sf), _messages(spark, sf), DIM), DIM)


#: Parameters of the checked layers, by a rule: two rows of eighths.
MATRIX = [[((7 * i + 3 * k) % 11 - 5) / 8 for i in range(DIM)] for k in range(2)]


def _mat(row: list[float], cols: list[str]) -> str:
    return "(" + " + ".join(f"{w} * {c}" for w, c in zip(row, cols, strict=True)) + ")"


_XS, _AS = [f"x{i}" for i in range(DIM)], [f"coalesce(a{i}, 0)" for i in range(DIM)]


@query(_agg_sql("avg({})", ", ".join([f"round({_mat(r, _XS)}, 5) AS h{k}" for k, r in enumerate(MATRIX)] + [f"round({_mat(r, _AS)}, 5) AS h{k + 2}" for k, r in enumerate(MATRIX)])))
def aggregate_mean_two_kernels(spark, sf):
    return _flat(M.get_aggregator("mean-2k", True)(_nodes(spark, sf), _messages(spark, sf), DIM, M.Weights(own=MATRIX, neighbor=MATRIX)), 4)


@query(_agg_sql("avg(w * {})", ", ".join(f"round(greatest({x}, 0), 5) AS h{i}" for i, x in enumerate(_XS)) + ", " + ", ".join(f"round(greatest({a}, 0), 5) AS h{i + DIM}" for i, a in enumerate(_AS))))
def sage_layer(spark, sf):
    links = graph(spark, sf).edges.where("etype = 9").select("src", "dst", F.col("w").alias("weight"))
    return _flat(M.sage_layer(_nodes(spark, sf), links, DIM), 2 * DIM)


@query(f""" , {_NODES}, deg AS (SELECT nodes.key, greatest(count(src), 1) AS d FROM nodes LEFT JOIN links ON src = nodes.key GROUP BY 1),
s AS (SELECT l.src AS key, {", ".join(f"sum(l.w * {_mat(r, ['n.' + x for x in _XS])} / sqrt(t.d)) AS a{k}" for k, r in enumerate(MATRIX))} FROM links l JOIN nodes n ON n.key = l.dst JOIN deg t ON t.key = l.dst GROUP BY 1)
SELECT deg.key, {", ".join(f"round(coalesce(a{k}, 0) / sqrt(d), 5) AS h{k}" for k in range(2))} FROM deg LEFT JOIN s USING (key)""")
def gcn_layer(spark, sf):
    links = graph(spark, sf).edges.where("etype = 9").select("src", "dst", F.col("w").alias("weight"))
    return _flat(M.gcn_layer(_nodes(spark, sf), links, DIM, MATRIX), 2)


@query(f""" , {_NODES}, g AS (SELECT src AS id, {", ".join(_XS)}, {" + ".join(f"tanh({_mat(r, _XS)}) * {v}" for r, v in zip(MATRIX, (1.0, -0.5), strict=True))} AS s FROM links JOIN nodes ON key = dst)
SELECT id, {", ".join(f"round(sum(exp(s) * {x}) / sum(exp(s)), 5) + 0.0 AS h{i}" for i, x in enumerate(_XS))} FROM g GROUP BY id""")
def semantic_attention(spark, sf):
    rows = graph(spark, sf).edges.where("etype = 9").join(_nodes(spark, sf).withColumnRenamed("key", "dst"), "dst").select(F.col("src").alias("id"), F.col("dst").alias("grp"), "x")
    return _flat(M.semantic_attention(rows, MATRIX, [1.0, -0.5], DIM), DIM, "id")


@query(f""" , {_NODES}, g AS (SELECT src AS id, {", ".join(f"o.x{i} AS x{i}" for i in range(DIM))}, {_mat(MATRIX[0], ["n." + x for x in _XS])} + {_mat(MATRIX[1], ["o." + x for x in _XS])} AS r FROM links JOIN nodes o ON o.key = dst JOIN nodes n ON n.key = src),
s AS (SELECT *, exp(CASE WHEN r > 0 THEN r ELSE 0.2 * r END) AS e FROM g) SELECT id, 0 AS head, {", ".join(f"round(sum(e * {x}) / sum(e), 5) + 0.0 AS h{i}" for i, x in enumerate(_XS))} FROM s GROUP BY id""")
def node_attention(spark, sf):
    own = _nodes(spark, sf).select(F.col("key").alias("src"), "x")
    other = _nodes(spark, sf).select(F.col("key").alias("dst"), F.col("x").alias("y"))
    rows = graph(spark, sf).edges.where("etype = 9").join(own, "src").join(other, "dst").select(F.col("src").alias("id"), F.lit(0).alias("head"), "x", "y")
    return _flat(M.node_attention(rows, MATRIX[0], MATRIX[1], DIM), DIM, "id", "head")


# Scores, losses, metrics: an edge's ends against two sampled negatives


_PAIRS = f""" , {_NODES}, r AS (SELECT src * 1000000 + dst AS pos, src, dst FROM links), {_negative_sql("r", 6, 2, "d.pos, d.src, d.dst")},
ends AS (SELECT pos, src, dst AS other, true AS positive FROM r UNION ALL SELECT pos, src, negative, false FROM negs),
scored AS (SELECT e.pos, e.src, e.other, e.positive, {" + ".join(f"a.x{i} * b.x{i}" for i in range(DIM))} AS logit,
  ({" + ".join(f"a.x{i} * b.x{i}" for i in range(DIM))}) / nullif(sqrt({" + ".join(f"a.x{i} * a.x{i}" for i in range(DIM))}) * sqrt({" + ".join(f"b.x{i} * b.x{i}" for i in range(DIM))}), 0) AS cosine FROM ends e JOIN nodes a ON a.key = e.src JOIN nodes b ON b.key = e.other)"""


def _scored(spark, sf):
    g = graph(spark, sf)
    rows = g.edges.where("etype = 9").select((F.col("src") * 1000000 + F.col("dst")).alias("pos"), "src", "dst")
    negs = negatives(g, rows, 6, 2).select("pos", "src", F.col("negative").alias("other"), F.lit(False).alias("positive"))
    ends = rows.select("pos", "src", F.col("dst").alias("other"), F.lit(True).alias("positive")).unionByName(negs)
    a, b = _nodes(spark, sf).toDF("src", "target"), _nodes(spark, sf).toDF("other", "context")
    return L.logits(ends.join(a, "src").join(b, "other")).withColumn("label", F.col("positive").cast("int"))


@query(_PAIRS + " SELECT pos, other, positive, count(*) AS k, round(max(logit), 5) AS logit, round(max(coalesce(cosine, 0)), 5) AS cosine FROM scored GROUP BY ALL")
def scores(spark, sf):
    rows = _scored(spark, sf).withColumn("cosine", cosine("target", "context"))
    return rows.groupBy("pos", "other", "positive").agg(F.count("*").alias("k"), F.round(F.max("logit"), 5).alias("logit"), F.round(F.max("cosine"), 5).alias("cosine"))


@query(_PAIRS + " SELECT round(avg(s), 5) AS loss FROM (SELECT pos, sum(CASE WHEN positive THEN ln(1 + exp(-logit)) ELSE ln(1 + exp(logit)) END) AS s FROM scored GROUP BY pos)")
def loss_neg_cross_entropy(spark, sf):
    return L.neg_cross_entropy(_scored(spark, sf)).select(F.round("loss", 5).alias("loss"))


@query(_PAIRS + " SELECT round(avg(ln(1 + exp(logit)) - CASE WHEN positive THEN logit ELSE 0 END), 5) AS loss FROM scored")
def loss_binary_cross_entropy(spark, sf):
    return L.binary_cross_entropy(_scored(spark, sf)).select(F.round("loss", 5).alias("loss"))


@query(_PAIRS + """, own AS (SELECT pos, max(logit) AS o FROM scored WHERE positive GROUP BY pos)
SELECT round(avg(1.0 / rank), 5) AS mrr FROM (SELECT pos, 1 + sum(CASE WHEN NOT positive AND logit >= o THEN 1 ELSE 0 END) AS rank FROM scored JOIN own USING (pos) GROUP BY pos)""")
def metric_mrr(spark, sf):
    return L.mrr(_scored(spark, sf)).select(F.round("mrr", 5).alias("mrr"))


@query(_PAIRS + " SELECT round(2 * sum(p * y) / (sum(p) + sum(y)), 5) AS f1 FROM (SELECT 1 / (1 + exp(-logit)) AS p, CAST(positive AS INT) AS y FROM scored)")
def metric_soft_f1(spark, sf):
    return L.soft_f1(_scored(spark, sf)).select(F.round("f1", 5).alias("f1"))


@query(_PAIRS + """, c AS (SELECT CAST(sum(CASE WHEN p = 1 AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, sum(CASE WHEN p = 1 AND y = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN p = 0 AND y = 1 THEN 1 ELSE 0 END) AS fn FROM (SELECT CAST(logit >= 0 AS INT) AS p, CAST(positive AS INT) AS y FROM scored)),
q AS (SELECT tp / (tp + fp + 1e-7) AS precision, tp / (tp + fn + 1e-7) AS recall FROM c) SELECT round(2 * precision * recall / (precision + recall + 1e-7), 5) AS f1, round(precision, 5) AS precision, round(recall, 5) AS recall FROM q""")
def metric_hard_f1(spark, sf):
    return L.hard_f1(_scored(spark, sf)).select(*[F.round(c, 5).alias(c) for c in ("f1", "precision", "recall")])


_LOGITS = f" , {_NODES}, l AS (SELECT vec_id, label, {_X} FROM embeddings), m AS (SELECT *, greatest({', '.join(_XS)}) AS top FROM l), p AS (SELECT *, CASE {' '.join(f'WHEN x{i} = top THEN {i}' for i in range(DIM))} END AS predicted FROM m)"


def _classified(spark, sf):
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), x.alias("logits"), "label")
    return rows.withColumn("predicted", L.predicted_class())


@query(_LOGITS + " SELECT round(avg(CAST(predicted = label AS DOUBLE)), 6) AS accuracy FROM p")
def metric_accuracy(spark, sf):
    return L.accuracy(_classified(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"))


@query(_LOGITS + f" SELECT round(avg(ln({' + '.join(f'exp({x})' for x in _XS)}) - CASE label {' '.join(f'WHEN {i} THEN x{i}' for i in range(DIM))} END), 5) AS loss FROM p")
def loss_softmax(spark, sf):
    return L.softmax_cross_entropy(_classified(spark, sf)).select(F.round("loss", 5).alias("loss"))


@query(_LOGITS + f" SELECT round(avg(({' + '.join(f'CASE WHEN label = {i} THEN ln(1 + exp(-x{i})) ELSE ln(1 + exp(x{i})) END' for i in range(DIM))}) / {DIM}), 5) AS loss FROM p")
def loss_multi_label(spark, sf):
    rows = _classified(spark, sf).withColumn("labels", F.array(*[(F.col("label") == i).cast("double") for i in range(DIM)]))
    return L.multi_label_soft_margin(rows).select(F.round("loss", 5).alias("loss"))


@query(_LOGITS + """, c AS (SELECT label AS c, CAST(predicted = label AS INT) AS tp, 0 AS fp, CAST(predicted <> label AS INT) AS fn FROM p UNION ALL SELECT predicted, 0, 1, 0 FROM p WHERE predicted <> label),
g AS (SELECT c, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c GROUP BY c)
SELECT round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) AS macro_f1, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM g""")
def metric_class_f1(spark, sf):
    return L.class_f1(_classified(spark, sf)).select(F.round("macro_f1", 6).alias("macro_f1"), F.round("micro_f1", 6).alias("micro_f1"))


def _discounts(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("score"), (F.col("l_linestatus") == "O").cast("int").alias("label"))


@query(""" , s AS (SELECT l_returnflag AS flag, l_quantity AS score, CAST(l_linestatus = 'O' AS INT) AS label FROM lineitem),
g AS (SELECT flag, score, sum(label) AS p, count(*) - sum(label) AS q FROM s GROUP BY ALL),
c AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY flag ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g)
SELECT flag, round(CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN CAST(sum(p * (b + q / 2)) AS DOUBLE) / (CAST(sum(p) AS DOUBLE) * CAST(sum(q) AS DOUBLE)) END, 6) AS auc FROM c GROUP BY flag""")
def metric_auc(spark, sf):
    return L.auc(_discounts(spark, sf), ("flag",)).select("flag", F.round("auc", 6).alias("auc"))


@query(""" , s AS (SELECT l_returnflag AS flag, l_quantity AS score, CAST(l_linestatus = 'O' AS INT) AS label FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY score DESC) AS place, sum(label) OVER (PARTITION BY flag) AS n FROM s),
f AS (SELECT *, max(CASE WHEN place = n THEN score END) OVER (PARTITION BY flag) AS floor FROM r), y AS (SELECT *, CAST(score >= floor AS INT) AS yes FROM f)
SELECT flag, round(2.0 * sum(yes * label) / (sum(yes) + sum(label)), 6) AS f1 FROM y GROUP BY flag""")
def metric_link_f1(spark, sf):
    return L.link_f1(_discounts(spark, sf), ("flag",)).select("flag", F.round("f1", 6).alias("f1"))


# Second-order walks of a usual length, sparse and sorted forms, encoders, models


@query(f" , {_walk_sql('vecs', ['9'] * 10, 1, (2, 4, 1))} SELECT walk, pos, path FROM w10")
def random_walk_second_order_ten(spark, sf):
    return _paths(random_walk(graph(spark, sf), vectors(spark, sf), [[9]] * 10, 1, p=0.5, q=2.0))


@query(" SELECT pos, vecs.id, etype, dst FROM vecs LEFT JOIN edges ON src = vecs.id AND etype = 9")
def neighbors_or_null(spark, sf):
    return full_neighbors(graph(spark, sf), vectors(spark, sf), [9], keep_missing=True).select("pos", "id", "etype", "dst")


def _rows50(spark, sf):
    return vectors(spark, sf).withColumn("batch", F.floor(F.col("pos") / 50))


@query(f""" , {_UNIQUE} SELECT i.batch, i.pos, i.slot, i."index", {vsum("e.embedding")} AS x, r.label FROM indexed i JOIN embeddings e ON e.vec_id * 8 + 6 = i.id JOIN embeddings r ON r.vec_id = i.pos""")
def sparse_features_label(spark, sf):
    nodes, links, labels = X.multi_hop_feature_label_sparse(graph(spark, sf), _rows50(spark, sf), [[9], [9]], [2, 2], ["embedding"], "label", batch="batch")
    found = links.join(nodes.select("batch", "index", _vsum("features").alias("x")), ["batch", "index"]).join(labels.select("pos", F.col("label")[0].alias("label")), "pos")
    return found.select("batch", "pos", "slot", "index", "x", "label")


@query(f""" , {_neighbor_sql("vecs", "9", 1, "context", "near")}, r0 AS (SELECT pos FROM near), {_negative_sql("r0", 6, 2, "d.pos")},
roots AS (SELECT pos * 4 + code AS pos, role, id FROM (SELECT pos, 0 AS code, 'target' AS role, id FROM near UNION ALL SELECT pos, 1, 'context', dst FROM near UNION ALL SELECT pos, 2 + k, 'negative', negative FROM negs)),
rr AS (SELECT pos, id FROM roots), {_hop_sql('rr', [("9", 2)])},
hr AS (SELECT role, h.pos // 4 // 50 AS batch, h.pos, slot, h.id FROM hops h JOIN roots USING (pos)),
nr AS (SELECT role, batch, id, row_number() OVER (PARTITION BY role, batch ORDER BY min(pos * 100 + slot)) - 1 AS "index" FROM hr GROUP BY role, batch, id)
SELECT role, batch, "index", nr.id, {vsum("embedding")} AS x FROM nr JOIN embeddings ON vec_id * 8 + 6 = nr.id""")
def sparse_features_negative(spark, sf):
    nodes, _ = X.multi_hop_feature_neg_sparse(graph(spark, sf), _rows50(spark, sf), [[9]], [2], ["embedding"], 6, 2, batch="batch")
    return nodes.select("role", "batch", "index", "id", _vsum("features").alias("x"))


_LINKS = "tree(edge_no, a, b) AS (VALUES " + ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(X.fanout_links([2, 2]))) + ")"


def _relation_sql(order: str) -> str:
    return f""" , {_UNIQUE}, {_LINKS}, l AS (SELECT c.batch, t.edge_no, c.pos, p."index" AS parent_index, c."index" AS child_index, CAST(c.w AS DOUBLE) AS weight FROM indexed c JOIN tree t ON t.b = c.slot JOIN indexed p ON p.pos = c.pos AND p.slot = t.a)
SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY {order}edge_no, pos) - 1 AS edge, parent_index, child_index, weight FROM l"""


@query(_relation_sql(""))
def relation_order(spark, sf):
    return X.relations(_indexed(spark, sf), [2, 2], batch="batch").select("batch", "edge", "parent_index", "child_index", "weight")


@query(_relation_sql("parent_index, "))
def relation_order_sorted(spark, sf):
    return X.relations(_indexed(spark, sf), [2, 2], True, "batch").select("batch", "edge", "parent_index", "child_index", "weight")


@query(_agg_sql("avg({})", ", ".join(f"round({_mat(r + r, _XS + _AS)}, 5) + 0.0 AS h{k}" for k, r in enumerate(MATRIX))))
def aggregate_mean_one_kernel(spark, sf):
    return _flat(M.get_aggregator("mean-1k", True)(_nodes(spark, sf), _messages(spark, sf), DIM, [r + r for r in MATRIX]), 2)


def _layer_sql(name: str, nodes: str) -> str:
    return f"{name}_s AS (SELECT src AS key, {', '.join(f'sum(o.x{i}) AS a{i}' for i in range(DIM))}, count(*) AS n FROM links JOIN {nodes} o ON o.key = dst GROUP BY src), {name} AS MATERIALIZED (SELECT nodes.key, {', '.join(f'(nodes.x{i} + coalesce(a{i}, 0)) / (coalesce(n, 0) + 1) AS x{i}' for i in range(DIM))} FROM {nodes} nodes LEFT JOIN {name}_s USING (key))"


@query(f" , {_NODES}, {_layer_sql('one', 'nodes')}, {_layer_sql('two', 'one')} SELECT key, {', '.join(f'round(x{i}, 5) + 0.0 AS h{i}' for i in range(DIM))} FROM two")
def message_passing_two(spark, sf):
    links = graph(spark, sf).edges.where("etype = 9").select("src", "dst")

    def layer(nodes, links):
        return M.gcn(nodes, links.join(nodes.withColumnRenamed("key", "dst"), "dst").select(F.col("src").alias("key"), "x"), DIM)

    return _flat(M.message_passing(_nodes(spark, sf), [links, links], [layer, layer]).withColumnRenamed("x", "h"), DIM)


@query(" SELECT p_partkey AS pos, round(CAST(p_size AS DOUBLE), 5) AS a, round(p_retailprice, 5) AS b, round(p_size + p_retailprice, 5) AS s, round(0.5 * p_size - p_retailprice, 5) + 0.0 AS m FROM part")
def features_combined(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.array(F.col("p_size").cast("double")).alias("u"), F.array(F.col("p_retailprice").cast("double")).alias("v"))
    out = M.combine_features(M.combine_features(rows, ["u", "v"], to="c"), ["u", "v"], "add", to="s")
    out = M.combine_features(out, ["u", "v"], matrix=[[0.5, -1.0]], to="m")
    return out.select("pos", F.round(F.col("c")[0], 5).alias("a"), F.round(F.col("c")[1], 5).alias("b"), F.round(F.col("s")[0], 5).alias("s"), (F.round(F.col("m")[0], 5) + 0.0).alias("m"))


@query(f" , {_NODES} SELECT key, " + ", ".join(f"round({_mat(r, _XS)} + {k}, 5) + 0.0 AS h{k}" for k, r in enumerate(MATRIX)) + " FROM nodes")
def encoder_dense(spark, sf):
    return _flat(M.dense_encoder(_nodes(spark, sf), "x", MATRIX, [0.0, 1.0]).withColumnRenamed("x", "h"), 2)


@query(f""" SELECT pos, cust.id, CASE WHEN vec_id IS NULL THEN 0.0 ELSE {vsum("embedding")} END AS x FROM cust LEFT JOIN embeddings ON vec_id = pos * 3""")
def encoder_embedding(spark, sf):
    rows = customers(spark, sf).withColumn("key", F.col("pos") * 3)
    vectors_of = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda v: v.cast("double")).alias("vector"))
    return M.embedding_lookup(rows, "key", vectors_of, "x", 64).select("pos", "id", _vsum("x").alias("x"))


@query(" SELECT id, vtype, CAST(CASE vtype WHEN 0 THEN 0.5 * w WHEN 1 THEN 2 * w ELSE w - 0.25 * vtype END AS DOUBLE) AS h FROM vertices WHERE vtype < 4")
def encoder_by_type(spark, sf):
    rows = graph(spark, sf).vertices.where("vtype < 4").withColumn("x", F.array(F.col("w").cast("double"), F.col("vtype").cast("double")))
    found = M.encode_by_type(rows, "vtype", {0: [[0.5, 0.0]], 1: [[2.0, 0.0]], 2: [[1.0, -0.25]], 3: [[1.0, -0.25]]})
    return found.select("id", "vtype", F.col("x")[0].alias("h"))


@query(_PAIRS + f" SELECT round(avg(s), 5) AS loss FROM (SELECT pos, sum(CASE WHEN positive THEN ln(1 + exp(-l)) ELSE ln(1 + exp(l)) END) AS s FROM (SELECT pos, positive, logit + 0.125 - ln(1 + other % 7) AS l FROM scored) GROUP BY pos)")
def loss_nce(spark, sf):
    rows = _scored(spark, sf).select("pos", F.col("target").alias("x"), F.col("context").alias("w"), F.lit(0.125).alias("b"), "positive", (1 + F.col("other") % 7).alias("expected"))
    return L.nce_loss(rows).select(F.round("loss", 5).alias("loss"))


@query(_LOGITS + f" SELECT round(avg(ln({' + '.join(f'exp({x})' for x in _XS)}) - CASE label {' '.join(f'WHEN {i} THEN x{i}' for i in range(DIM))} END), 5) AS loss, round(avg(CAST(predicted = label AS DOUBLE)), 6) AS accuracy FROM p")
def model_supervised(spark, sf):
    return Supervised(lambda rows: rows).evaluate(_classified(spark, sf)).select(F.round("loss", 5).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


@query(_PAIRS + """, own AS (SELECT pos, max(logit) AS o FROM scored WHERE positive GROUP BY pos),
m AS (SELECT avg(1.0 / rank) AS mrr FROM (SELECT pos, 1 + sum(CASE WHEN NOT positive AND logit >= o THEN 1 ELSE 0 END) AS rank FROM scored JOIN own USING (pos) GROUP BY pos)),
l AS (SELECT avg(s) AS loss FROM (SELECT pos, sum(CASE WHEN positive THEN ln(1 + exp(-logit)) ELSE ln(1 + exp(logit)) END) AS s FROM scored GROUP BY pos))
SELECT round(loss, 5) AS loss, round(mrr, 5) AS mrr FROM l, m""")
def model_unsupervised(spark, sf):
    return Unsupervised().evaluate(_scored(spark, sf).drop("logit", "label")).select(F.round("loss", 5).alias("loss"), F.round("mrr", 5).alias("mrr"))


@query(""" , s AS (SELECT l_returnflag AS flag, l_quantity AS score, CAST(l_linestatus = 'O' AS INT) AS label FROM lineitem),
g AS (SELECT flag, score, sum(label) AS p, count(*) - sum(label) AS q FROM s GROUP BY ALL),
c AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY flag ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g),
a AS (SELECT flag, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN CAST(sum(p * (b + q / 2)) AS DOUBLE) / (CAST(sum(p) AS DOUBLE) * CAST(sum(q) AS DOUBLE)) END AS auc FROM c GROUP BY flag),
r AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY score DESC) AS place, sum(label) OVER (PARTITION BY flag) AS n FROM s),
f AS (SELECT *, max(CASE WHEN place = n THEN score END) OVER (PARTITION BY flag) AS floor FROM r), y AS (SELECT *, CAST(score >= floor AS INT) AS yes FROM f),
z AS (SELECT flag, 2.0 * sum(yes * label) / (sum(yes) + sum(label)) AS f1 FROM y GROUP BY flag)
SELECT round(avg(auc), 6) AS auc, round(avg(f1), 6) AS f1 FROM a JOIN z USING (flag) WHERE auc IS NOT NULL""")
def metric_link_mean(spark, sf):
    return L.link_quality(_discounts(spark, sf), "flag").select(F.round("auc", 6).alias("auc"), F.round("f1", 6).alias("f1"))


@query(f" , {_NODES} SELECT src AS a, dst AS b, round(({' + '.join(f'p.x{i} * q.x{i}' for i in range(DIM))}) / (sqrt({' + '.join(f'p.x{i} * p.x{i}' for i in range(DIM))}) * sqrt({' + '.join(f'q.x{i} * q.x{i}' for i in range(DIM))})), 5) + 0.0 AS score FROM links JOIN nodes p ON p.key = src JOIN nodes q ON q.key = dst")
def link_cosine_scores(spark, sf):
    x = _nodes(spark, sf).select(F.col("key").alias("id"), F.col("x").alias("embedding"))
    twice = x.unionByName(x)  # an id's vectors are averaged
    pairs = graph(spark, sf).edges.where("etype = 9").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return L.link_scores(pairs, twice).select("a", "b", (F.round("score", 5) + 0.0).alias("score"))


# Text, stored graphs, attributes of other kinds, vertices without weight


_TEXT_SCHEMA = """{"vertexes": [{"vtype": 0, "entity": "DT_INT64", "weight": "DT_DOUBLE", "attrs": [{"name": "segment", "dtype": "DT_STRING"}, {"name": "codes", "dtype": "DT_ARRAY_INT64"}]}, {"vtype": 1, "entity": "DT_INT64"}],
 "edges": [{"etype": 0, "entity_1": "DT_INT64", "entity_2": "DT_INT64", "weight": "DT_DOUBLE"}]}"""


def _text_graph(spark, sf) -> Graph:
    """Customers and orders as text records, read, converted and loaded. Every vertex and edge is there twice, and some edges have an unknown source."""
    c, o, at = table(spark, sf, "customer"), table(spark, sf, "orders"), scratch(spark, "text-graph")
    v0 = c.select(F.concat_ws("\t", F.lit("0"), (F.col("c_custkey") * 8).cast("string"), F.lit("1.5"), "c_mktsegment", F.concat_ws(",", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"))).alias("value"))
    v1 = o.select(F.concat_ws("\t", F.lit("1"), (F.col("o_orderkey") * 8 + 1).cast("string")).alias("value"))
    again = c.select(F.concat_ws("\t", F.lit("1"), (F.col("c_custkey") * 8).cast("string")).alias("value"))
    e0 = o.select(F.concat_ws("\t", F.lit("0"), (F.col("o_custkey") * 8).cast("string"), (F.col("o_orderkey") * 8 + 1).cast("string"), F.lit("2.25")).alias("value"))
    lost = o.select(F.concat_ws("\t", F.lit("0"), F.lit("-5"), (F.col("o_orderkey") * 8 + 1).cast("string"), F.lit("1")).alias("value"))
    v0.union(v1).union(again).write.text(f"{at}/v")
    e0.union(lost).write.text(f"{at}/e")
    schema = GraphSchema.parse(_TEXT_SCHEMA)
    convert(spark, f"{at}/v", f"{at}/e", schema, f"{at}/stored")
    return load_graph(spark, f"{at}/stored", schema)


@query(""" SELECT 0 AS vtype, c_custkey * 8 AS id, CAST(1.5 AS DOUBLE) AS weight FROM customer UNION ALL SELECT 1, o_orderkey * 8 + 1, 1.0 FROM orders""")
def text_graph_vertices(spark, sf):
    return _text_graph(spark, sf).vertices.select("vtype", "id", "weight")


@query(" SELECT 0 AS etype, o_custkey * 8 AS src, o_orderkey * 8 + 1 AS dst, CAST(2.25 AS DOUBLE) AS weight FROM orders")
def text_graph_edges(spark, sf):
    return _text_graph(spark, sf).edges.select("etype", "src", "dst", "weight")


@query(" SELECT c_custkey AS pos, c_mktsegment AS segment, c_custkey AS code0, CAST(c_nationkey AS BIGINT) AS code1 FROM customer")
def text_graph_features(spark, sf):
    found = vertex_features(_text_graph(spark, sf), customers(spark, sf), ["segment", "codes"])
    return found.select("pos", F.col("segment")[0].alias("segment") if dict(found.dtypes)["segment"].startswith("array") else "segment", F.col("codes")[0].alias("code0"), F.col("codes")[1].alias("code1"))


@query(" SELECT o_custkey AS x, o_orderkey AS y, epoch FROM orders, range(2) t(epoch) ")
def dataset_text_lines(spark, sf):
    at = scratch(spark, "lines")
    table(spark, sf, "orders").select("o_custkey", "o_orderkey").write.csv(at)
    both = [text_line_dataset(spark, at, ["x", "y"], "*.csv", worker=k, workers=2, repeat=2, shuffle_seed=5) for k in range(2)]
    return both[0].unionByName(both[1]).select("x", "y", F.col("epoch").cast("long").alias("epoch"))


@query(f" SELECT vec_id AS id, {vsum('embedding')} AS x FROM embeddings")
def saved_embeddings(spark, sf):
    at = scratch(spark, "embeddings")
    save_predictions(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id"), at, save_embedding)
    return spark.read.parquet(at).select("id", _vsum("embedding").alias("x"))


@query(_entity_sql("(SELECT 0 AS vtype, id, 1 AS w FROM parts)", "vtype", [0], 700, "vertex", "id", "d.vtype, d.k, i.id", "id"))
def sample_vertices_weightless(spark, sf):
    """Vertices that all weigh nothing are drawn evenly."""
    rows = parts(spark, sf).select("id").withColumn("weight", F.lit(0).cast("long"))
    none = spark.createDataFrame([], "src long, dst long")
    return sample_vertices(Graph.of({0: rows}, {0: none}), [0], 700)


# Datasets


@query(" SELECT range AS pos, 5 + 3 * range AS id FROM range(332)")
def dataset_range(spark, sf):
    return range_dataset(spark, 5, 1000, 3)


@query(_entity_sql("vertices", "vtype", [6], 500, "vertex", "id", "d.k // 32 AS batch, d.k AS pos, d.vtype, i.id", "id").replace("range(500)", "range(CAST(ceil((SELECT count(*) FROM embeddings) / 32) * 32 AS BIGINT))"))
def dataset_vertices(spark, sf):
    return vertex_dataset(graph(spark, sf), [6], 32, table(spark, sf, "embeddings").count())


@query(_entity_sql(_KEYS, "etype", [9], 500, "edge", "src", "d.k // 64 AS batch, d.k AS pos, d.etype, i.src, i.dst", "src, dst").replace("range(500)", "range(CAST(ceil((SELECT count(*) FROM embeddings) / 64) * 64 AS BIGINT))"))
def dataset_edges(spark, sf):
    return edge_dataset(graph(spark, sf), [9], 64, table(spark, sf, "embeddings").count())


@query(f" , {_hop_sql('cust', [('0', 2)])} SELECT pos % 2 AS worker, pos // 2 // 16 AS batch, h.pos, h.slot, h.id FROM hops h")
def dataset_pipeline_hops(spark, sf):
    g = graph(spark, sf)
    both = [dataset_pipeline(customers(spark, sf), lambda rows: multi_hop(g, rows, [[0]], [2]), batch_size=16, worker=k, workers=2).withColumn("worker", F.lit(k).cast("long")) for k in range(2)]
    return both[0].unionByName(both[1]).select("worker", F.floor(F.floor(F.col("pos") / 2) / 16).alias("batch"), "pos", "slot", "id")


@query(" SELECT round(min(o_totalprice), 4) AS lo, round(avg(o_totalprice), 4) AS mean, round(max(o_totalprice), 4) AS hi, round(avg(CASE WHEN o_orderkey >= 100 THEN o_totalprice END), 4) AS recent FROM orders")
def running_statistics(spark, sf):
    s = statistics(table(spark, sf, "orders").withColumn("pos", F.col("o_orderkey")), "o_totalprice", since=100)
    return s.select(*[F.round(f"o_totalprice_{a}", 4).alias(b) for a, b in (("min", "lo"), ("mean", "mean"), ("max", "hi"), ("recent", "recent"))])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
