import json

import pytest

from relgraph.cli import main
from relgraph.operators.graph import tpch_graph, tpch_mapping, tpch_tables
from relgraph.plans import mapping as M, pgq
from relgraph.types import graph_type, spark_type


def test_pgq_round_trip():
    m = tpch_mapping()
    assert pgq.parse(pgq.render(m)) == m
    assert M.from_yaml(M.to_yaml(m)) == m


def test_pgq_defaults_comments_and_quotes():
    m = pgq.parse('create property graph g vertex tables ("My T" key (k) /* c */, b key (i) label B no properties) -- x\nedge tables (b source key (i) references b destination key (k) references "My T")')
    assert m.vertices[0] == M.VertexMapping("My T", "My T", "k") and m.vertices[1].label == "B"
    assert m.edges[0] == M.EdgeMapping("b", "b", "B", "My T", "i", "k")
    assert pgq.parse(pgq.render(m)) == m


@pytest.mark.parametrize("text", ["create graph g", "create property graph g vertex tables ()", "create property graph g vertex tables (a key (x, y))", "create property graph g vertex tables (a key (x)) edge tables (e source key (a) references z destination key (b) references a)", "create property graph g vertex tables (a key (x)) ! "])
def test_pgq_errors(text):
    with pytest.raises(SyntaxError):
        pgq.parse(text)


def test_check_finds_faults():
    m = M.GraphMapping("g", (M.VertexMapping("a", "t", "k", {"x": "p", "y": "p"}), M.VertexMapping("a", "u", "k")), (M.EdgeMapping("e", "t", "a", "z", "s", "d"),))
    assert len(M.check(m)) == 3 and not M.check(tpch_mapping())


def test_json_and_schema_forms():
    text = json.dumps({"graph": "g", "types": [{"type": "VERTEX", "name": "a", "table_name": "A", "id_column_name": "K", "properties": [{"column_name": "X", "property_name": "x"}]}, {"type": "EDGE", "name": "e", "table_name": "E", "source_label": "a", "destination_label": "a", "source_column_name": "S", "destination_column_name": "D"}]})
    m = M.folded(M.from_json(text))
    assert m.vertices[0] == M.VertexMapping("a", "a", "k", {"x": "x"}) and m.edges[0].src == "s"
    schema = {"name": "g", "vertex_types": [{"type_name": "a", "properties": [{"name": "x"}]}], "edge_types": [{"type_name": "e", "vertex_type_pair_relations": [{"source_vertex": "a", "destination_vertex": "a"}]}]}
    sources = {"vertices_datasource": [{"type_name": "a", "location": "A", "id_column": "K", "property_mapping": [{"property": "x", "column": "X"}]}], "edges_datasource": [{"type_name": "e", "source_vertex": "a", "target_vertex": "a", "location": "E", "source_column": "S", "destination_column": "D"}]}
    assert M.folded(M.from_schema_and_sources(schema, sources)) == m


def test_families_and_undirected_survive():
    m = M.GraphMapping("g", (M.VertexMapping("a", "t", "k", {"x": "x", "y": "y"}, (("x", "y"),)),), (M.EdgeMapping("e", "t", "a", "a", "k", "x", {}, True),))
    assert M.from_yaml(M.to_yaml(m)) == m


def test_types():
    assert [graph_type(spark_type(t)) for t in ("BIGINT", "varchar(30)", "double precision", "timestamp with time zone", "date", "int", "datetime(6)")] == ["LONG", "STRING", "DOUBLE", "DATETIME", "DATE", "INT", "DATETIME"]
    with pytest.raises(TypeError):
        spark_type("interval")


def test_schema_renderings(spark, sf):
    m, tables = tpch_mapping(), tpch_tables(spark, sf)
    native = M.schema_json(m, tables)["schema"]
    assert native[0] == {"id": 0, "label": "region", "type": "VERTEX", "properties": [{"id": 0, "name": "name", "data_type": "STRING"}]}
    assert native[6]["id"] == 6 and native[6]["relations"] == [{"source": "nation", "destination": "region"}]
    assert M.schema_json(m, tables, "interactive")["schema"][2]["primary_keys"] == ["c_custkey"]
    ids = [p["propertyId"] for x in M.schema_json(m, tables, "ids")["schema"] for p in x["properties"]]
    assert ids == list(range(len(ids)))


def test_only_mapped_columns_are_read(spark, sf):
    plan = tpch_graph(spark, sf).edges["supplied_by"]._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" not in plan and "Python" not in plan


def test_cli(tmp_path, capsys):
    (tmp_path / "m.sql").write_text(pgq.render(tpch_mapping()))
    assert main(["check", str(tmp_path / "m.sql")]) == 0
    assert main(["to-yaml", str(tmp_path / "m.sql")]) == 0
    (tmp_path / "m.yaml").write_text(capsys.readouterr().out.split("\n", 1)[1])
    assert main(["to-sql", str(tmp_path / "m.yaml")]) == 0
    assert pgq.parse(capsys.readouterr().out) == tpch_mapping()
