"""Relational-to-graph mappings: their forms on disk, and the per-label plans they compile to."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, functions as F

from relgraph.types import graph_type


@dataclass(frozen=True)
class VertexMapping:
    """A table whose rows are vertices: its key column, and the columns that become properties."""

    label: str
    table: str
    key: str
    props: dict[str, str] = field(default_factory=dict)  # column -> property
    families: tuple[tuple[str, ...], ...] = ()  # a layout hint without effect here


@dataclass(frozen=True)
class EdgeMapping:
    """A table whose rows are edges: an association table, or a vertex table with a foreign key."""

    label: str
    table: str
    src_label: str
    dst_label: str
    src: str
    dst: str
    props: dict[str, str] = field(default_factory=dict)
    undirected: bool = False


@dataclass(frozen=True)
class GraphMapping:
    name: str
    vertices: tuple[VertexMapping, ...]
    edges: tuple[EdgeMapping, ...]
    database: str = ""

    def vertex(self, label: str) -> VertexMapping:
        return next(v for v in self.vertices if v.label == label)

    def edge(self, label: str) -> EdgeMapping:
        return next(e for e in self.edges if e.label == label)

    def tables(self) -> dict[str, list[VertexMapping | EdgeMapping]]:
        """The mappings that each source table feeds, vertices first: the fan-out of a row."""
        out: dict[str, list] = {}
        for m in (*self.vertices, *self.edges):
            out.setdefault(m.table, []).append(m)
        return out

    def label_ids(self) -> dict[str, int]:
        """Vertex labels count from 0 in order, edge labels on from there."""
        return {m.label: i for i, m in enumerate((*self.vertices, *self.edges))}


def check(mapping: GraphMapping) -> list[str]:
    """What is wrong with a mapping; nothing if it can be compiled."""
    out = []
    labels = [m.label for m in (*mapping.vertices, *mapping.edges)]
    out += [f"label {x} is mapped {labels.count(x)} times" for x in dict.fromkeys(labels) if labels.count(x) > 1]
    known = {v.label for v in mapping.vertices}
    for e in mapping.edges:
        out += [f"edge {e.label} refers to unknown vertex label {x}" for x in (e.src_label, e.dst_label) if x not in known]
    for m in (*mapping.vertices, *mapping.edges):
        named = list(m.props.values())
        out += [f"{m.label} has property {x} twice" for x in dict.fromkeys(named) if named.count(x) > 1]
    return out


def folded(mapping: GraphMapping) -> GraphMapping:
    """Tables and columns in lower case; property names stay."""
    low = lambda props: {c.lower(): p for c, p in props.items()}
    return replace(
        mapping,
        vertices=tuple(replace(v, table=v.table.lower(), key=v.key.lower(), props=low(v.props)) for v in mapping.vertices),
        edges=tuple(replace(e, table=e.table.lower(), src=e.src.lower(), dst=e.dst.lower(), props=low(e.props)) for e in mapping.edges),
    )


# Forms on disk.


def from_dict(d: dict[str, Any]) -> GraphMapping:
    """From the structure that the YAML form holds."""
    vertices = [
        VertexMapping(
            v["type_name"],
            v["dataSourceName"],
            v["idFieldName"],
            {m["dataField"]["name"]: m["property"] for m in v.get("mappings") or []},
            tuple(tuple(f["columns"]) if isinstance(f, dict) else tuple(f) for f in v.get("columnFamily") or []),
        )
        for v in d["vertexMappings"]["vertex_types"]
    ]
    edges = []
    for e in (d.get("edgeMappings") or {}).get("edge_types") or []:
        pair = e["type_pair"]
        edges.append(
            EdgeMapping(
                pair["edge"],
                e["dataSourceName"],
                pair["source_vertex"],
                pair["destination_vertex"],
                e["sourceVertexMappings"][0]["dataField"]["name"],
                e["destinationVertexMappings"][0]["dataField"]["name"],
                {m["dataField"]["name"]: m["property"] for m in e.get("dataFieldMappings") or []},
                bool(pair.get("undirected", False)),
            )
        )
    return GraphMapping(d.get("graph", "graph"), tuple(vertices), tuple(edges), d.get("database", ""))


def to_dict(m: GraphMapping) -> dict[str, Any]:
    def props(p: dict[str, str]) -> list[dict]:
        return [{"property": x, "dataField": {"name": c}} for c, x in p.items()]

    return {
        "graph": m.name,
        "database": m.database,
        "vertexMappings": {
            "vertex_types": [
                {"type_name": v.label, "dataSourceName": v.table, "idFieldName": v.key, "mappings": props(v.props)}
                | ({"columnFamily": [{"columns": list(f)} for f in v.families]} if v.families else {})
                for v in m.vertices
            ]
        },
        "edgeMappings": {
            "edge_types": [
                {
                    "type_pair": {"edge": e.label, "source_vertex": e.src_label, "destination_vertex": e.dst_label} | ({"undirected": True} if e.undirected else {}),
                    "dataSourceName": e.table,
                    "sourceVertexMappings": [{"dataField": {"name": e.src}}],
                    "destinationVertexMappings": [{"dataField": {"name": e.dst}}],
                    "dataFieldMappings": props(e.props),
                }
                for e in m.edges
            ]
        },
    }


def from_yaml(text: str) -> GraphMapping:
    return from_dict(yaml.safe_load(text))


def to_yaml(m: GraphMapping) -> str:
    return yaml.safe_dump(to_dict(m), sort_keys=False)


def format_yaml(text: str) -> str:
    """The same mapping with table and column names in lower case, in canonical order."""
    return to_yaml(folded(from_yaml(text)))


def from_json(text: str) -> GraphMapping:
    """From the list form: ``types`` of VERTEX and EDGE entries with table_name and column names."""
    d = json.loads(text)
    vertices, edges = [], []
    for t in d["types"]:
        props = {c["column_name"]: c.get("property_name", c["column_name"]) for c in t.get("properties") or t.get("mappings") or []}
        if t["type"].upper() == "VERTEX":
            vertices.append(VertexMapping(t["name"], t["table_name"], t["id_column_name"], props))
        else:
            edges.append(
                EdgeMapping(t["name"], t["table_name"], t["source_label"], t["destination_label"], t["source_column_name"], t["destination_column_name"], props, bool(t.get("undirected", False)))
            )
    return GraphMapping(d.get("graph", "graph"), tuple(vertices), tuple(edges), d.get("database", ""))


def from_schema_and_sources(schema: dict[str, Any], sources: dict[str, Any]) -> GraphMapping:
    """Join a graph schema (types with properties) with data sources (where each type's rows are), by name."""
    vertex_at = {s["type_name"]: s for s in sources["vertices_datasource"]}
    edge_at = {(s["source_vertex"], s["type_name"], s["target_vertex"]): s for s in sources["edges_datasource"]}

    def props(kind: dict, source: dict) -> dict[str, str]:
        columns = {m["property"]: m["column"] for m in source.get("property_mapping") or []}
        return {columns.get(p["name"], p["name"]): p["name"] for p in kind.get("properties") or []}

    vertices = [VertexMapping(t["type_name"], (s := vertex_at[t["type_name"]])["location"], s["id_column"], props(t, s)) for t in schema["vertex_types"]]
    edges = []
    for t in schema["edge_types"]:
        for pair in t["vertex_type_pair_relations"]:
            s = edge_at[pair["source_vertex"], t["type_name"], pair["destination_vertex"]]
            edges.append(EdgeMapping(t["type_name"], s["location"], pair["source_vertex"], pair["destination_vertex"], s["source_column"], s["destination_column"], props(t, s)))
    return GraphMapping(schema.get("name", "graph"), tuple(vertices), tuple(edges))


# Schema renderings.


def typed_props(m: VertexMapping | EdgeMapping, df: DataFrame) -> list[tuple[str, str]]:
    kinds = {f.name.lower(): f.dataType for f in df.schema.fields}
    return [(p, graph_type(kinds[c.lower()])) for c, p in m.props.items()]


def schema_json(m: GraphMapping, tables: dict[str, DataFrame], style: str = "native") -> dict[str, Any]:
    """The typed graph schema: ``native`` (label ids and property lists), ``interactive`` (types with primary keys)
    or ``ids`` (typeId and propertyId, property ids running over all labels)."""
    ids, running, out = m.label_ids(), 0, []
    for x in (*m.vertices, *m.edges):
        vertex, props = isinstance(x, VertexMapping), typed_props(x, tables[x.table])
        entry: dict[str, Any] = {"id": ids[x.label], "label": x.label, "type": "VERTEX" if vertex else "EDGE"}
        if style == "native":
            entry["properties"] = [{"id": i, "name": p, "data_type": t} for i, (p, t) in enumerate(props)]
        elif style == "interactive":
            entry = {"type_id": ids[x.label], "type_name": x.label, "properties": [{"property_id": i, "property_name": p, "property_type": t} for i, (p, t) in enumerate(props)]}
            entry |= {"primary_keys": [x.props.get(x.key, x.key)]} if vertex else {}
        else:
            entry |= {"typeId": entry.pop("id"), "properties": [{"propertyId": running + i, "name": p, "dataType": t} for i, (p, t) in enumerate(props)]}
            running += len(props)
        if not vertex:
            entry["relations"] = [{"source": x.src_label, "destination": x.dst_label}]
        out.append(entry)
    return {"graph": m.name, "schema": out}


# Compilation.


def columns_of(m: VertexMapping | EdgeMapping) -> list[Column]:
    return [F.col(c).alias(p) for c, p in m.props.items()]


def vertex_plan(m: VertexMapping, df: DataFrame) -> DataFrame:
    """(oid, properties) of a table; only mapped columns are read, integer keys are long."""
    return df.select(identifier(df, m.key).alias("oid"), *columns_of(m)).filter("oid is not null")


def edge_plan(m: EdgeMapping, df: DataFrame) -> DataFrame:
    """(src, dst, properties) of a table; rows with a null endpoint are no edges."""
    return df.select(identifier(df, m.src).alias("src"), identifier(df, m.dst).alias("dst"), *columns_of(m)).filter("src is not null and dst is not null")


def identifier(df: DataFrame, column: str) -> Column:
    return F.col(column) if df.schema[column].dataType.simpleString() == "string" else F.col(column).cast("long")
