"""Selectors of graph data and algorithm results: ``v.id``, ``v.data``, ``e.src``, ``r``, ``v:label.property`` and so on."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, functions as F

from relgraph.operators.graph import PropertyGraph, SimpleGraph

PATTERN = re.compile(r"(v|e|r)(?::(?:label)?([^.]+))?(?:\.(.+))?$")


def parse(selector: str) -> tuple[str, str | None, str | None]:
    """(kind, label, field) of a selector; labels may be numbers by position."""
    m = PATTERN.match(selector.strip())
    if not m or (m[1] != "r" and not m[3]):
        raise ValueError(f"not a selector: {selector!r}")
    return m[1], m[2], m[3]


def label_name(names: list[str], label: str) -> str:
    return names[int(label)] if label.isdigit() and label not in names else label


def select(graph: PropertyGraph | SimpleGraph, result: DataFrame | None, wanted: dict[str, str] | str, vertex_range: tuple | None = None) -> DataFrame:
    """The columns that ``wanted`` (name -> selector, or that as JSON) asks for, of one vertex or edge label.

    ``r`` is the result's value (its first column after the id), ``r.name`` one of its columns; results have ``id`` or ``oid``.
    vertex_range = (first, end) bounds vertex ids, either side open by None."""
    wanted = json.loads(wanted) if isinstance(wanted, str) else wanted
    parsed = {c: parse(s) for c, s in wanted.items()}
    kinds = {k for k, _, _ in parsed.values()}
    if "e" in kinds and len(kinds) > 1:
        raise ValueError("edge selectors cannot be mixed with others")
    labels = {x for _, x, _ in parsed.values() if x is not None}
    if len(labels) > 1:
        raise ValueError("selectors must share one label")
    label = next(iter(labels), None)
    if "e" in kinds:
        base = graph.edges[label_name(list(graph.edges), label)] if isinstance(graph, PropertyGraph) else graph.edges
        fields = {f: "weight" if f == "data" and "weight" in base.columns else f for _, _, f in parsed.values()}
        return base.select(*[F.col(fields[f]).alias(c) for c, (_, _, f) in parsed.items()])
    if isinstance(graph, PropertyGraph):
        name = label_name(list(graph.vertices), label) if label is not None else next(iter(graph.vertices))
        base, key, number = graph.vertices[name], "oid", list(graph.vertices).index(name)
    else:
        base, key, number = graph.vertices, "id", 0
    if vertex_range:
        first, end = vertex_range
        base = base.filter((F.lit(True) if first is None else F.col(key) >= first) & (F.lit(True) if end is None else F.col(key) < end))
    values = []
    if result is not None:
        own = key if key in result.columns else "id" if "id" in result.columns else "oid"
        values = [c for c in result.columns if c not in (own, "label")]
        base = base.join(result.select(F.col(own).alias(key), *[F.col(c).alias(f"__r_{c}") for c in values]), key, "left")
    columns = []
    for c, (kind, _, f) in parsed.items():
        if kind == "r":
            source = F.col(f"__r_{f or values[0]}")
        else:
            source = F.col(key) if f == "id" else F.lit(number) if f == "label_id" else F.col(f)
        columns.append(source.alias(c))
    return base.select(*columns)


def context_value(result: DataFrame, node, key: str = "id") -> dict | None:
    """The result's row of one vertex."""
    row = result.filter(F.col(key) == F.lit(node)).first()
    return row.asDict() if row else None


def tensor(result: DataFrame, column: str, order: str = "id"):
    """A numpy array of one column in order of another: a result that its caller knows to be small."""
    import numpy as np

    return np.array([r[0] for r in result.orderBy(order).select(column).collect()])
