"""Readers and writers on small files, and the streaming parser."""

import json

import pytest
from pyspark.sql import functions as F

from columnloom.operators import evaluate, graph
from columnloom.sources import readers, writers
from columnloom.streaming.matches import stream_matches


@pytest.fixture
def root(tmp_path):
    for source in ("source1", "source2", "source10"):
        (tmp_path / source).mkdir()
    (tmp_path / "source2" / "b.csv").write_text("id,name.x,v\n1,a,1.5\n2,,2\n3,c,\n4,d,4\n5,e,5\n6,f,x\n")
    (tmp_path / "source2" / "a.csv").write_text("only\n")
    (tmp_path / "source2" / "source2_semantic_view.json").write_text(json.dumps({"description": "Two", "schema_inventory": [{"table_name": "b", "columns": ["id", "v"]}, {"table_name": "a", "columns": ["only"]}]}))
    (tmp_path / "source2" / "b_semantic_view.json").write_text(json.dumps({"table_name": "b", "description": "B", "columns": [{"column_name": "id", "data_type": "int64", "samples": ["1"]}, {"column_name": "v"}]}))
    (tmp_path / "source2" / "b_columns_semantic_view.json").write_text('{"z": "last name first", "a.b (c)": "x", "v": "y"}')
    (tmp_path / "source2" / "t_metadata.json").write_text('{"id": {"type": "integer"}, "v": {"type": "varchar(9)"}}')
    (tmp_path / "domains.json").write_text('{"domain_1": ["source2", "source1"], "domain_0": ["source10"]}')
    (tmp_path / "config.json").write_text('{"data_path": "d", "api_key": "never kept"}')
    (tmp_path / "truth").mkdir()
    flat = {"source_id": "source1", "source_table": "t", "source_column": "c", "target_id": "source2", "target_table": "b", "target_column": "v"}
    (tmp_path / "truth" / "answer1.json").write_text(json.dumps({"matches": [flat, flat]}))
    (tmp_path / "truth" / "answer5.json").write_text(json.dumps([{"aligned_columns": [{"source_id": s, "table": "t", "column": "c"} for s in ("source1", "source2", "source3")]}]))
    (tmp_path / "truth" / "notes.txt").write_text("no truth")
    return str(tmp_path)


def test_listing(spark, root):
    assert readers.sources(spark, root) == ["source1", "source2", "source10"]
    assert readers.tables(spark, root, "source2") == ["a", "b"] and readers.tables(spark, root, "source9") == []
    assert readers.table_views(spark, root, "source2") == ["b"]
    assert readers.load_config(spark, f"{root}/config.json") == readers.Config(data_path="d")


def test_csv(spark, root):
    assert readers.csv_header(spark, f"{root}/source2/b.csv") == ["id", "name.x", "v"]
    assert readers.csv_header(spark, f"{root}/source2/missing.csv") == []
    assert dict(readers.csv_head(spark, f"{root}/source2/b.csv").dtypes)["v"] == "double"
    assert dict(readers.csv_table(spark, f"{root}/source2/b.csv").dtypes)["v"] == "string"


def test_views(spark, root):
    assert [r.table_name for r in readers.source_view(spark, root, "source2").orderBy("ordinal").collect()] == ["b", "a"]
    assert [(r.column_name, r.data_type, r.samples) for r in readers.table_view(spark, root, "source2", "b").orderBy("ordinal").collect()] == [("id", "int64", ["1"]), ("v", "unknown", [])]
    assert [r.column_name for r in readers.column_view(spark, root, "source2", "b").orderBy("ordinal").collect()] == ["z", "a.b (c)", "v"]
    assert {r.column_name: r.declared_type for r in readers.declared_types(spark, f"{root}/source2/t_metadata.json").collect()} == {"id": "integer", "v": "varchar(9)"}
    assert [(r.domain_id, r.source_id) for r in readers.domain_map(spark, f"{root}/domains.json").orderBy("domain_ord", "source_ord").collect()] == [("domain_1", "source2"), ("domain_1", "source1"), ("domain_0", "source10")]


def test_truth(spark, root):
    flat, anchors = readers.truth(spark, f"{root}/truth")
    assert [tuple(r) for r in evaluate.gt_pairs_flat(flat).collect()] == [("answer1", "source1.t.c", "source2.b.v")]
    assert evaluate.gt_pairs_group(anchors).count() == 3 and anchors.first().label == "answer5"


def test_writers(spark, tmp_path):
    docs = spark.createDataFrame([("d", "x"), ("d", "x"), ("d", "y")], "domain_id string, text string")
    assert writers.documents(docs, str(tmp_path / "docs")).count() == 2
    assert writers.documents(docs, str(tmp_path / "docs")).count() == 2
    found = spark.createDataFrame([("d", "s1", "s2", "a", "b", 0), ("d", "s1", "s3", "a", "c", 1)], "domain_id string, source_a string, source_b string, col_a string, col_b string, checkpoint int")
    writers.checkpoint(found, found.drop("col_a", "col_b"), str(tmp_path / "run"))
    writers.checkpoint(found.where("checkpoint = 1"), found.where("checkpoint = 1").drop("col_a", "col_b"), str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run" / "matches")).count() == 2
    writers.matches(found, str(tmp_path / "matches"))
    assert spark.read.json(str(tmp_path / "matches")).columns == ["col_a", "col_b", "domain"]
    views = spark.createDataFrame([("s1", "t", "b", 0, "x"), ("s1", "t", "a", 1, "y")], "source_id string, table_name string, column_name string, ordinal int, description string")
    writers.column_views(views, str(tmp_path / "views"))
    line = next((tmp_path / "views" / "source_id=s1").glob("*.json")).read_text()
    assert '"columns":{"b":"x","a":"y"}' in line


def test_knowledge_text_and_log(spark, tmp_path):
    blocks = spark.createDataFrame([(2, "b"), (1, "a")], "n int, text string").coalesce(1)
    writers.knowledge_text(blocks, str(tmp_path / "kb"), "n")
    text = "".join(p.read_text() for p in sorted((tmp_path / "kb").glob("part-*")))
    assert text == "a\n\n===\n\nb\n\n===\n\n"
    for step in (1, 2):
        writers.audit_log(spark.createDataFrame([(step, "q", "a")], "step int, question string, answer string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    metrics = spark.createDataFrame([("ALL", 2, 2, 1, 1, 1, 0.5, 0.5, 0.5), ("a", 1, 1, 1, 0, 0, 1.0, 1.0, 1.0)], "label string, n_truth int, n_predicted int, tp int, fp int, fn int, precision double, recall double, f1 double")
    assert [line.split(":")[0] for line in writers.report(metrics)] == ["a", "ALL"]


def test_graph_store(spark, tmp_path):
    nodes = spark.createDataFrame([("d1", "a"), ("d2", "b")], "domain_id string, node_id string")
    edges = spark.createDataFrame([("d1", "a", "x"), ("d2", "b", "y")], "domain_id string, src_id string, tgt_id string")
    graph.write_graph(nodes, edges, str(tmp_path))
    graph.write_graph(nodes.where("domain_id = 'd1'").withColumn("node_id", F.lit("new")), edges.where("domain_id = 'd1'"), str(tmp_path))
    assert sorted(r.node_id for r in graph.read_graph(spark, str(tmp_path))[0].collect()) == ["b", "new"]
    assert [r.node_id for r in graph.read_graph(spark, str(tmp_path), "d2")[0].collect()] == ["b"]


def test_stream(spark, tmp_path):
    answers = spark.createDataFrame([("d", 1, "s1.a <-> s2.b\ns2.b <-> s1.a", "2024-01-01 00:00:00"), ("d", 2, "s1.a <-> s9.q", "2024-01-01 00:01:00")], "domain_id string, response_id int, response string, ts string").selectExpr("domain_id", "response_id", "response", "to_timestamp(ts) AS ts")
    answers.write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([(1, "s1.a"), (1, "s2.b")], "response_id int, column_id string")
    stream = stream_matches(spark.readStream.schema(answers.schema).parquet(str(tmp_path / "in")), known)
    query = stream.writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.sql("SELECT * FROM found").collect()] == [("d", 1, "s1.a", "s2.b")]


def test_values_with_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"two\nlines"\n2,"say ""so"""\n')
    (tmp_path / "b.csv").write_text('k,v\n1,"say ""so"""\n')
    assert [tuple(r) for r in readers.csv_table(spark, str(tmp_path / "a.csv")).collect()] == [(1, "two\nlines"), (2, 'say "so"')]
    assert [tuple(r) for r in readers.csv_table(spark, str(tmp_path / "b.csv")).collect()] == [(1, 'say "so"')]


def test_repeated_column_name(spark, tmp_path):
    rows = spark.createDataFrame([("s", "t", "a", 0, "first"), ("s", "t", "b", 1, "other"), ("s", "t", "a", 2, "last")], "source_id string, table_name string, column_name string, ordinal int, description string")
    writers.column_views(rows, str(tmp_path / "views"))
    assert [r.value for r in spark.read.text(str(tmp_path / "views")).collect()] == ['{"table_name":"t","columns":{"a":"last","b":"other"}}']


def test_all_sources(spark, tmp_path):
    for name in ("source2", "source10", "source19", "source01", "other", "source3x"):
        (tmp_path / name).mkdir()
    assert readers.sources(spark, str(tmp_path)) == ["source2", "source10", "source19"]
    assert readers.sources(spark, str(tmp_path), 10) == ["source2", "source10"]
