"""The property graph on a small graph of four cities and three lines, and layers and metrics by hand."""

import json

import pytest

from plexora.functions.draws import cumulated
from plexora.operators import messages as M
from plexora.operators import metrics as L
from plexora.operators import transforms as X
from plexora.operators.embedding import Supervised, train_vertex_embedding
from plexora.operators.entity import sample_edges, sample_vertices
from plexora.operators.features import edge_features, vertex_features
from plexora.operators.neighbors import full_neighbors, inputs, neighbor_offsets, sample_neighbors, topk_arrays, topk_neighbors
from plexora.operators.sequences import context_pairs, multi_hop, multi_hop_arrays, random_walk
from plexora.sources.datasets import BaseInputs, dataset_pipeline, evaluation_ids, range_dataset, tensor_dataset, text_line_dataset
from plexora.sources.schema import GraphSchema, SchemaError
from plexora.sources.text import convert, load_graph, read_graph
from plexora.streaming.sources import degree_updates, stream_neighbors

SCHEMA = {
    "vertexes": [
        {"vtype": 0, "entity": "DT_INT64", "weight": "DT_DOUBLE", "attrs": [{"name": "zone", "dtype": "DT_INT32"}, {"name": "height", "dtype": "DT_DOUBLE"}]},
        {"vtype": 1, "entity": "DT_INT64", "weight": "DT_DOUBLE", "attrs": [{"name": "tracks", "dtype": "DT_INT32"}, {"name": "stops", "dtype": "DT_ARRAY_INT64"}, {"name": "title", "dtype": "DT_STRING"}]},
    ],
    "edges": [
        {"etype": 0, "entity_1": "DT_INT64", "entity_2": "DT_INT64", "weight": "DT_DOUBLE"},
        {"etype": 1, "entity_1": "DT_INT64", "entity_2": "DT_INT64", "weight": "DT_DOUBLE", "attrs": [{"name": "load", "dtype": "DT_INT64"}]},
    ],
}
CITIES, LINES = [11, 12, 13, 14], [21, 22, 23]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("graph")
    v = [f"0\t{i}\t2.0\t7\t1.5" for i in CITIES] + [f"1\t{i}\t4.0\t9\t{10 * j + 1},{10 * j + 2},5\tline,{j}" for j, i in enumerate(LINES)]
    e = [f"0\t{a}\t{b}\t2.5" for a, b in ((11, 21), (12, 21), (21, 12), (21, 13), (21, 14))] + [f"1\t{i}\t11\t6.0\t40" for i in LINES]
    (d / "v.txt").write_text("\n".join(v) + "\n")
    (d / "e.txt").write_text("\n".join(e) + "\t\n")  # one trailing separator
    return d


@pytest.fixture(scope="module")
def graph(spark, files):
    return read_graph(spark, str(files / "v.txt"), str(files / "e.txt"), GraphSchema.parse(json.dumps(SCHEMA)))


def test_counts_and_storage(spark, graph, files):
    assert tuple(graph.meta().first()) == (7, 8)
    schema = GraphSchema.parse(json.dumps(SCHEMA))
    convert(spark, str(files / "v.txt"), str(files / "e.txt"), schema, str(files / "out"))
    assert tuple(load_graph(spark, str(files / "out"), schema).meta().first()) == (7, 8)


@pytest.mark.parametrize("change", [lambda s: s.pop("edges"), lambda s: s["vertexes"][0].update(entity="DT_INT32"), lambda s: s["vertexes"][1].update(vtype=2), lambda s: s["edges"][0].update(weight="DT_INT8"), lambda s: s["vertexes"][0]["attrs"][0].update(dtype="DT_X")])
def test_schema_errors(change):
    s = json.loads(json.dumps(SCHEMA))
    change(s)
    with pytest.raises(SchemaError):
        GraphSchema.parse(json.dumps(s))


def test_entity_samples(graph):
    rows = sample_vertices(graph, [0, 1], 300).collect()
    assert len(rows) == 600 and {r.id for r in rows if r.vtype == 0} == set(CITIES)
    assert {r.id for r in sample_vertices(graph, [], 400).collect()} == {*CITIES, *LINES}
    assert {(r.src, r.dst) for r in sample_edges(graph, [1], 300).collect()} == {(i, 11) for i in LINES}
    with pytest.raises(ValueError, match="vertex type"):
        sample_vertices(graph, [-1, 8], 3)


def test_neighbors(spark, graph):
    one = inputs(spark, [21])
    drawn = sample_neighbors(graph, one, [], 200).collect()
    assert {r.dst for r in drawn} == set(CITIES) and {r.weight for r in drawn} == {2.5, 6.0}
    assert {r.dst for r in sample_neighbors(graph, one, [0], 100).collect()} == {12, 13, 14}
    assert topk_neighbors(graph, one, [], 1).first().dst == 11
    many = inputs(spark, [11, 12, 22, 23, 11])
    assert [r.dst for r in topk_neighbors(graph, many, [0, 1], 1).orderBy("pos").collect()] == [21, 21, 11, 11, 21]
    assert topk_arrays(graph, one, [], 4).first().weights == [2.5, 2.5, 2.5, 6.0]
    assert [(r.offset, r.n) for r in neighbor_offsets(graph, inputs(spark, [21, 13, 11])).orderBy("pos").collect()] == [(0, 4), (4, 0), (4, 1)]
    assert full_neighbors(graph, inputs(spark, []), None).count() == 0
    with pytest.raises(Exception, match="too few neighbors of 13"):
        full_neighbors(graph, inputs(spark, [13]), strict=True).collect()


def test_draws_follow_the_weights(spark, graph):
    drawn = sample_neighbors(graph, inputs(spark, [21] * 4000), [], 1).groupBy("dst").count().collect()
    got = {r.dst: r["count"] for r in drawn}
    want = {11: 6 / 13.5, 12: 2.5 / 13.5, 13: 2.5 / 13.5, 14: 2.5 / 13.5}
    assert sum((got[k] - 4000 * p) ** 2 / (4000 * p) for k, p in want.items()) < 16.3  # chi-square, 3 degrees, 0.001
    line = cumulated(spark.createDataFrame([(1, 0), (2, 0)], "id long, w long").selectExpr("1 as g", "*"), ["g"], ["id"])
    assert [(r.lo, r.hi) for r in line.orderBy("id").collect()] == [(0, 1), (1, 2)]  # no weight at all: evenly


def test_features(spark, graph):
    rows = vertex_features(graph, inputs(spark, [22, 23, 21, 22]), ["tracks", "stops"], [2, 2]).orderBy("pos").collect()
    assert [r.stops for r in rows] == [[11, 12], [21, 22], [1, 2], [11, 12]] and all(r.tracks == [9] for r in rows)
    assert [r["vtype"] for r in vertex_features(graph, inputs(spark, [21, 11]), ["vtype"]).orderBy("pos").collect()] == [[1], [0]]
    assert vertex_features(graph, inputs(spark, [22]), ["title"]).first()["title"] == ["line,1"]
    edges = spark.createDataFrame([(0, 1, 22, 11)], "pos long, etype int, src long, dst long")
    assert edge_features(graph, edges, ["load"]).first().load == [40]
    for bad in (lambda: vertex_features(graph, inputs(spark, [1]), ["zone"]), lambda: vertex_features(graph, inputs(spark, [21]), ["nope"]), lambda: vertex_features(graph, inputs(spark, [21]), ["title"], numeric=True)):
        with pytest.raises(Exception, match="no |numeric"):
            bad().collect()


def test_sequences(spark, graph):
    rows = inputs(spark, [11, 12])
    assert [len(r.ids) for r in multi_hop_arrays(multi_hop(graph, rows, [[0], [0, 1]], [2, 3])).collect()] == [9, 9]
    for p, q in ((1, 1), (0.5, 2)):
        walks = random_walk(graph, rows, [[0], [0, 1]], 2, p, q)
        assert [len(r.path) for r in walks.collect()] == [3] * 4 and {r.path[1] for r in walks.collect()} == {21}
        assert context_pairs(walks, 2).count() == 24
    for bad in (lambda: random_walk(graph, rows, [], 1), lambda: random_walk(graph, rows, [[0]], 1, p=0), lambda: multi_hop(graph, rows, [[0], [9]], [1, 1])):
        with pytest.raises(ValueError, match="."):
            bad()


def test_second_order_step_follows_p_and_q(spark, graph):
    walks = random_walk(graph, inputs(spark, [11] * 4000), [[0], [0, 1]], 1, p=0.5, q=2.0).groupBy(walk_end()).count().collect()
    got = {r[0]: r["count"] for r in walks}
    w = {11: 6.0 * 2, 12: 2.5 / 2, 13: 2.5 / 2, 14: 2.5 / 2}
    assert sum((got[k] - 4000 * x / sum(w.values())) ** 2 / (4000 * x / sum(w.values())) for k, x in w.items()) < 16.3


def test_hops_of_vertices_without_neighbors(spark, graph):
    found = multi_hop(graph, inputs(spark, [13, 21]), [[0], [0]], [2, 2]).orderBy("pos", "slot").collect()
    assert [(r.level, r.slot, r.parent) for r in found if r.pos == 0] == [(0, 0, None)]
    own = [r for r in found if r.pos == 1]
    assert [r.slot for r in own if r.level < 2] == [0, 1, 2] and all(r.id == 21 for r in own if r.level == 2)
    assert {r.parent for r in own if r.level == 2} == {r.slot for r in own if r.level == 1 and r.id == 12}


def test_second_order_walks_have_plans_that_grow_by_the_step(spark, graph):
    def exchanges(steps):
        walks = random_walk(graph, inputs(spark, [11]), [[0, 1]] * steps, 1, 0.5, 2.0)
        return walks._jdf.queryExecution().executedPlan().toString().count("Exchange ")

    few, many = exchanges(3), exchanges(6)
    assert many <= 2.5 * few


def test_inputs_and_missing_neighbors(spark, graph):
    assert full_neighbors(graph, inputs(spark, [13, 22]), keep_missing=True).where("dst is null").count() == 1
    given = BaseInputs(train=lambda s: inputs(s, [11]))
    assert given.train_data(spark).first().id == 11
    with pytest.raises(ValueError, match="no predict data"):
        given.predict_data(spark)
    with pytest.raises(ValueError, match="no known dataset"):
        evaluation_ids(graph, "nope")
    assert {r.id for r in evaluation_ids(graph, "cora").collect()} == set(LINES)


def walk_end():
    from pyspark.sql import functions as F

    return F.element_at("path", -1)


def test_second_order_step_prefers_common_neighbors(spark):
    from plexora.operators.graph import Graph

    v = spark.createDataFrame([(i,) for i in range(4)], "id long")
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (1, 2), (1, 3)], "src long, dst long")
    g = Graph.of({0: v}, {0: e})
    ends = random_walk(g, inputs(spark, [0] * 3000), [[0], [0]], 1, p=1000, q=1000).where("path[1] = 1").groupBy(walk_end()).count().collect()
    assert max(ends, key=lambda r: r["count"])[0] == 2 and {r[0]: r["count"] for r in ends}[2] > 1000  # 2 is a neighbor of 0 and of 1


def test_relation_template_and_unique_index(spark):
    assert X.fanout_links([2, 3]) == [(0, 1), (0, 2), (1, 3), (1, 4), (1, 5), (2, 6), (2, 7), (2, 8)]
    assert X.fanout_dim([2, 3]) == 9
    hops = spark.createDataFrame([(0, 0, 5), (0, 1, 7), (0, 2, 5), (1, 0, 7), (1, 1, 9), (1, 2, 5)], "pos long, slot long, id long")
    indexed = X.unique_index(hops)
    assert {(r["id"], r["index"]) for r in indexed.collect()} == {(5, 0), (7, 1), (9, 2)}
    links = [(r.parent_index, r.child_index) for r in X.relations(indexed, [2]).orderBy("edge").collect()]
    assert links == [(0, 1), (1, 2), (0, 0), (1, 0)]
    links = [(r.parent_index, r.child_index) for r in X.relations(indexed, [2], sort_indices=True).orderBy("edge").collect()]
    assert links == [(0, 1), (0, 0), (1, 2), (1, 0)]
    assert [r["index"] for r in X.targets(indexed).orderBy("pos").collect()] == [0, 1]


def test_layers_by_hand(spark):
    nodes = spark.createDataFrame([(1, [1.0, -2.0]), (2, [3.0, 4.0]), (3, [5.0, 6.0])], "key long, x array<double>")
    links = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0)], "src long, dst long, weight double")
    got = {r.key: r.h for r in M.sage_layer(nodes, links, 2, "mean", activation=None).collect()}
    assert got[1] == [1.0, -2.0, 6.5, 8.0] and got[2] == [3.0, 4.0, 0.0, 0.0]
    got = {r.key: r.h for r in M.sage_layer(nodes, links, 2, "gcn", activation=None).collect()}
    assert got[1] == pytest.approx([14 / 3, 14 / 3])
    got = {r.key: r.h for r in M.gcn_layer(nodes, links, 2).collect()}
    assert got[1] == pytest.approx([13 / 2**0.5, 16 / 2**0.5])
    with pytest.raises(ValueError, match="no aggregator"):
        M.get_aggregator("lstm")


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(0, 2.0, True, 1), (0, 2.0, False, 0), (0, 1.0, False, 0), (1, 5.0, True, 1), (1, 1.0, False, 0)], "pos long, logit double, positive boolean, label int")
    assert L.mrr(rows).first().mrr == pytest.approx(0.75)
    assert L.auc(rows.withColumnRenamed("logit", "score")).first().auc == pytest.approx(5.5 / 6)
    assert L.get_metric("f1")(rows).first().recall == pytest.approx(1.0)
    classes = spark.createDataFrame([([1.0, 3.0], 1), ([2.0, 0.0], 1)], "logits array<double>, label int")
    assert Supervised(lambda d: d).evaluate(classes).first().accuracy == 0.5
    with pytest.raises(ValueError, match="no loss"):
        L.get_loss("x")


def test_datasets(spark, graph, tmp_path):
    assert [r.id for r in range_dataset(spark, 3, 10, 3).orderBy("pos").collect()] == [3, 6, 9]
    (tmp_path / "a.csv").write_text("1,2\n3,4\n")
    assert text_line_dataset(spark, str(tmp_path), ["x", "y"], "*.csv").count() == 2
    assert tensor_dataset(spark, {"a": [1, 2], "b": [3.0, 4.0]}).count() == 2
    out = dataset_pipeline(range_dataset(spark, 0, 10), lambda d: d.where("id > 2"), batch_size=2, worker=1, workers=2)
    assert sorted((r.batch, r.id) for r in out.collect()) == [(0, 3), (1, 5), (1, 7), (2, 9)]
    looped = graph.with_self_loops(0)
    assert looped.edges.where("src = dst").count() == 4 and graph.with_reverse({0: 1}).edges.count() == 13


def test_embeddings_from_walks(spark, graph):
    walks = random_walk(graph, inputs(spark, [11, 12]), [[0], [0, 1]], 5)
    rows = train_vertex_embedding(walks, dim=4, partitions=1).collect()
    assert 21 in {r.id for r in rows} and all(len(r.embedding) == 4 for r in rows)


def test_streams(spark, graph, tmp_path):
    spark.createDataFrame([(k, 21, f"2024-01-01 00:{k:02d}:00") for k in range(20)], "pos long, id long, t string").selectExpr("pos", "id", "cast(t as timestamp) as ts", "id as src").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pos long, id long, ts timestamp, src long").parquet(str(tmp_path / "in"))
    for name, df, mode in (("hops", stream_neighbors(graph, stream, [0]), "append"), ("degrees", degree_updates(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {r.dst for r in spark.table("hops").collect()} <= {12, 13, 14} and spark.table("hops").count() == 20
    assert spark.table("degrees").first().degree == 20


def test_catalogue_has_sql_for_every_query():
    from plexora.plans import catalogue

    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
