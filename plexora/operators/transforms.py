"""Training samples from inputs (pos, id): neighborhoods with features, labels, negatives, relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexora.operators.entity import negatives
from plexora.operators.features import concatenated, unique_features, vertex_features
from plexora.operators.graph import Graph
from plexora.operators.neighbors import sample_neighbors
from plexora.operators.sequences import context_pairs, multi_hop, random_walk

#: A transform is any function DataFrame -> DataFrame; df.transform applies it.
Transform = Callable[[DataFrame], DataFrame]


def fanout_levels(fanouts: list[int]) -> list[int]:
    """Numbers of nodes per level: 1, f1, f1*f2, ..."""
    out = [1]
    for f in fanouts:
        out.append(out[-1] * f)
    return out


def fanout_dim(fanouts: list[int]) -> int:
    return sum(fanout_levels(fanouts))


def fanout_links(fanouts: list[int]) -> list[tuple[int, int]]:
    """(parent slot, child slot) of every link of the level-ordered tree."""
    sizes, out, first = fanout_levels(fanouts), [], 0
    for size, f in zip(sizes, fanouts, strict=False):
        out += [(first + k, first + size + k * f + j) for k in range(size) for j in range(f)]
        first += size
    return out


def multi_hop_features(graph: Graph, rows: DataFrame, metapath: list, fanouts: list[int], names: list[str], dims: list[int] | None = None, seed: int = 1) -> DataFrame:
    """multi_hop with the concatenated features of each node; different ids are looked up once."""
    return concatenated(unique_features(graph, multi_hop(graph, rows, metapath, fanouts, seed), names, dims), names)


def with_labels(graph: Graph, rows: DataFrame, label: str, dim: int = 0) -> DataFrame:
    """(pos, id, label) of the roots."""
    return vertex_features(graph, rows.select("pos", "id"), [label], [dim], strict=False)


def multi_hop_feature_label(graph: Graph, rows: DataFrame, metapath: list, fanouts: list[int], names: list[str], label: str, dims: list[int] | None = None, seed: int = 1) -> DataFrame:
    found = multi_hop_features(graph, rows, metapath, fanouts, names, dims, seed)
    return found.join(with_labels(graph, rows, label).select("pos", label), "pos", "left")


def target_context_negative(graph: Graph, rows: DataFrame, types: list[int] | None, vertex_type: int, count: int, seed: int = 1) -> DataFrame:
    """(pos, role, k, id): the input as target, one sampled neighbor as context, count negatives; inputs without neighbors go."""
    context = sample_neighbors(graph, rows, types, 1, seed, "context").select("pos", F.lit("context").alias("role"), F.lit(0).cast("long").alias("k"), F.col("dst").alias("id"))
    kept = rows.join(context.select("pos"), "pos", "left_semi")
    target = kept.select("pos", F.lit("target").alias("role"), F.lit(0).cast("long").alias("k"), "id")
    negative = negatives(graph, kept.select("pos"), vertex_type, count, seed).select("pos", F.lit("negative").alias("role"), "k", F.col("negative").alias("id"))
    return target.unionByName(context).unionByName(negative)


def multi_hop_feature_neg(graph: Graph, rows: DataFrame, metapath: list, fanouts: list[int], names: list[str], vertex_type: int, count: int, dims: list[int] | None = None, seed: int = 1) -> DataFrame:
    """multi_hop_features of targets, contexts and negatives: adds root, role and k."""
    roots = target_context_negative(graph, rows, metapath[0], vertex_type, count, seed)
    code = F.when(F.col("role") == "target", 0).when(F.col("role") == "context", 1).otherwise(2 + F.col("k"))
    roots = roots.withColumn("root", F.col("pos")).withColumn("pos", F.col("pos") * (count + 2) + code)
    found = multi_hop_features(graph, roots.select("pos", "id"), metapath, fanouts, names, dims, seed)
    return found.join(roots.select("pos", "root", "role", "k"), "pos")


def _keys(batch: str | list[str] | None) -> list[str]:
    return [batch] if isinstance(batch, str) else list(batch or [])


def unique_index(found: DataFrame, batch: str | list[str] | None = None) -> DataFrame:
    """Adds index: the number of the node's id among the different ids, by first appearance (pos, slot), within each batch."""
    keys = _keys(batch)
    first = found.groupBy(*keys, "id").agg(F.min(F.struct("pos", "slot")).alias("_f"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_f")) - 1  # one row per different id of a batch
    return found.join(first.withColumn("index", number.cast("long")).drop("_f"), [*keys, "id"])


def sparse_form(graph: Graph, found: DataFrame, names: list[str], dims: list[int] | None = None, batch: str | list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes: index, id, features), (links of slots to indices: pos, slot, index)."""
    indexed = unique_index(found, batch)
    keys = _keys(batch)
    nodes = indexed.select(*keys, "index", "id").distinct().withColumn("pos", F.col("index"))
    nodes = concatenated(unique_features(graph, nodes, names, dims), names).drop("pos")
    return nodes, indexed.select(*keys, "pos", "slot", "index")


def bipartite(found: DataFrame, depth: int) -> list[DataFrame]:
    """Links (pos, src_slot, src, dst_slot, dst, weight) from each level to the next, deepest first."""
    out = []
    for level in range(depth, 0, -1):
        child = found.where(F.col("level") == level).select("pos", F.col("parent").alias("src_slot"), F.col("slot").alias("dst_slot"), F.col("id").alias("dst"), "weight")
        parent = found.where(F.col("level") == level - 1).select("pos", F.col("slot").alias("src_slot"), F.col("id").alias("src"))
        out.append(child.join(parent, ["pos", "src_slot"]).select("pos", "src_slot", "src", "dst_slot", "dst", "weight"))
    return out


def multi_hop_feature_label_sparse(graph: Graph, rows: DataFrame, metapath: list, fanouts: list[int], names: list[str], label: str, dims: list[int] | None = None, seed: int = 1, batch: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sparse_form of multi_hop, and (pos, id, label) of the roots. A batch is a column of rows, which is joined back by pos."""
    nodes, links = sparse_form(graph, _batched(multi_hop(graph, rows.select("pos", "id"), metapath, fanouts, seed), rows, batch), names, dims, batch)
    return nodes, links, with_labels(graph, rows, label)


def multi_hop_feature_neg_sparse(graph: Graph, rows: DataFrame, metapath: list, fanouts: list[int], names: list[str], vertex_type: int, count: int, dims: list[int] | None = None, seed: int = 1, batch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """sparse_form of multi_hop from targets, contexts and negatives, with the column role; ids are numbered apart per role.

    pos is root * (count + 2) + 0 for targets, + 1 for contexts, + 2 + k for negatives.
    """
    roots = target_context_negative(graph, rows.select("pos", "id"), metapath[0], vertex_type, count, seed)
    code = F.when(F.col("role") == "target", 0).when(F.col("role") == "context", 1).otherwise(2 + F.col("k"))
    found = multi_hop(graph, roots.select((F.col("pos") * (count + 2) + code).alias("pos"), "id"), metapath, fanouts, seed)
    part = F.col("pos") % (count + 2)
    found = found.withColumn("role", F.when(part == 0, "target").when(part == 1, "context").otherwise("negative"))
    if batch:
        found = found.withColumn("_root", F.floor(F.col("pos") / (count + 2))).join(rows.select(F.col("pos").alias("_root"), batch), "_root").drop("_root")
    return sparse_form(graph, found, names, dims, ["role", *_keys(batch)])


def _batched(found: DataFrame, rows: DataFrame, batch: str | None) -> DataFrame:
    return found.join(rows.select("pos", batch), "pos") if batch else found


def relations(indexed: DataFrame, fanouts: list[int], sort_indices: bool = False, batch: str | None = None) -> DataFrame:
    """(edge, edge_no, pos, parent_index, child_index, weight) of the links between unique indices.

    edge numbers a batch's links from 0: in the order (edge_no, pos), or by parent_index first where sorted.
    """
    spark = indexed.sparkSession
    links = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(fanout_links(fanouts))], "edge_no long, parent_slot long, child_slot long")
    keys = [batch] if batch else []
    parent = indexed.select("pos", F.col("slot").alias("parent_slot"), F.col("index").alias("parent_index"))
    weight = F.col("weight") if "weight" in indexed.columns else F.lit(1.0)
    child = indexed.select(*keys, "pos", F.col("slot").alias("child_slot"), F.col("index").alias("child_index"), weight.alias("weight"))
    found = child.join(F.broadcast(links), "child_slot").join(parent, ["pos", "parent_slot"])  # links: as many as the tree has
    order = (["parent_index"] if sort_indices else []) + ["edge_no", "pos"]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return found.select(*keys, number.cast("long").alias("edge"), "edge_no", "pos", "parent_index", "child_index", "weight")


def targets(indexed: DataFrame) -> DataFrame:
    return indexed.where("slot = 0").select("pos", "index")


def edge_neg(graph: Graph, edges: DataFrame, vertex_type: int, count: int, seed: int = 1) -> DataFrame:
    """edges(pos, src, dst) -> (pos, target, context, k, negative)."""
    rows = edges.select("pos", F.col("src").alias("target"), F.col("dst").alias("context"))
    return negatives(graph, rows, vertex_type, count, seed)


def neighbor_neg(graph: Graph, rows: DataFrame, vertex_type: int, types: list[int] | None, count: int, seed: int = 1) -> DataFrame:
    """(pos, target, context, k, negative): one sampled neighbor and count negatives per input."""
    context = sample_neighbors(graph, rows, types, 1, seed, "context").select("pos", F.col("id").alias("target"), F.col("dst").alias("context"))
    return negatives(graph, context, vertex_type, count, seed)


def random_walk_neg(graph: Graph, rows: DataFrame, vertex_type: int, metapath: list, count: int, context_size: int, repetition: int = 1, p: float = 1.0, q: float = 1.0, seed: int = 1) -> DataFrame:
    """(pos, walk, n, target, context, k, negative) over the context pairs of walks; pos is a hash of (walk, n)."""
    pairs = context_pairs(random_walk(graph, rows, metapath, repetition, p, q, seed), context_size)
    pairs = pairs.drop("pos").withColumn("pos", F.concat_ws("/", "walk", "n"))
    return negatives(graph, pairs.select("pos", "walk", "n", "target", "context"), vertex_type, count, seed)


def unique_pair(pairs: DataFrame) -> DataFrame:
    """pairs(pos, x, y) -> the different pairs (x, y, index) with the pos of their first appearance."""
    return pairs.groupBy("x", "y").agg(F.min("pos").alias("index"))
