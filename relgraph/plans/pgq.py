"""SQL/PGQ ``CREATE PROPERTY GRAPH``: a recursive-descent reader and a printer."""

from __future__ import annotations

import re

from relgraph.plans.mapping import EdgeMapping, GraphMapping, VertexMapping

TOKEN = re.compile(r"""\s*(?:--[^\n]*\n|/\*.*?\*/|("(?:[^"]|"")*"|`[^`]*`)|([A-Za-z_][\w$.]*)|([(),;]))""", re.S)


class Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                raise SyntaxError(f"unexpected {text[at:].strip()[:20]!r}")
            at = m.end()
            if m[1]:
                self.tokens.append(("name", m[1][1:-1].replace('""', '"')))
            elif m[2] or m[3]:
                self.tokens.append(("word" if m[2] else "mark", m[2] or m[3]))
        self.at = 0

    def peek(self, *words: str) -> bool:
        found = self.tokens[self.at : self.at + len(words)]
        return len(found) == len(words) and all(k != "name" and v.upper() == w for (k, v), w in zip(found, words))

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            got = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
            raise SyntaxError(f"expected {' '.join(words)}, found {got}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] == "mark":
            raise SyntaxError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def one(self) -> str:
        """A parenthesised single column; compound keys are not supported."""
        self.need("(")
        out = self.name()
        self.need(")")
        return out

    def listed(self, item) -> list:
        self.need("(")
        out = [item()]
        while self.take(","):
            out.append(item())
        self.need(")")
        return out

    def properties(self) -> dict[str, str]:
        if self.take("NO", "PROPERTIES"):
            return {}
        if not self.take("PROPERTIES"):
            return {}
        return dict(self.listed(self.property))

    def property(self) -> tuple[str, str]:
        column = self.name()
        return column, self.name() if self.take("AS") else column

    def vertex(self) -> VertexMapping:
        table = self.name()
        self.need("KEY")
        key = self.one()
        label = self.name() if self.take("LABEL") else table
        return VertexMapping(label, table, key, self.properties())

    def edge(self) -> EdgeMapping:
        table = self.name()
        ends = []
        for word in ("SOURCE", "DESTINATION"):
            self.need(word, "KEY")
            column = self.one()
            self.need("REFERENCES")
            ends.append((column, self.name()))
        label = self.name() if self.take("LABEL") else table
        return EdgeMapping(label, table, ends[0][1], ends[1][1], ends[0][0], ends[1][0], self.properties())


def parse(text: str) -> GraphMapping:
    """The mapping that a statement declares; REFERENCES may name a vertex table or its label."""
    r = Reader(text)
    r.need("CREATE", "PROPERTY", "GRAPH")
    name = r.name()
    r.need("VERTEX", "TABLES")
    vertices = r.listed(r.vertex)
    edges = r.listed(r.edge) if r.take("EDGE", "TABLES") else []
    r.take(";")
    if r.at < len(r.tokens):
        raise SyntaxError(f"unexpected {r.tokens[r.at][1]}")
    by_table = {v.table: v.label for v in vertices} | {v.label: v.label for v in vertices}
    fixed = []
    for e in edges:
        for x in (e.src_label, e.dst_label):
            if x not in by_table:
                raise SyntaxError(f"edge {e.label} refers to unknown table {x}")
        fixed.append(EdgeMapping(e.label, e.table, by_table[e.src_label], by_table[e.dst_label], e.src, e.dst, e.props))
    return GraphMapping(name, tuple(vertices), tuple(fixed))


def quoted(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_][\w$.]*", name) else '"' + name.replace('"', '""') + '"'


def render(m: GraphMapping) -> str:
    """The statement that declares a mapping."""

    def props(p: dict[str, str]) -> str:
        if not p:
            return "NO PROPERTIES"
        return "PROPERTIES (" + ", ".join(quoted(c) if c == x else f"{quoted(c)} AS {quoted(x)}" for c, x in p.items()) + ")"

    vertices = [f"  {quoted(v.table)} KEY ({quoted(v.key)}) LABEL {quoted(v.label)} {props(v.props)}" for v in m.vertices]
    edges = [
        f"  {quoted(e.table)} SOURCE KEY ({quoted(e.src)}) REFERENCES {quoted(e.src_label)}"
        f" DESTINATION KEY ({quoted(e.dst)}) REFERENCES {quoted(e.dst_label)} LABEL {quoted(e.label)} {props(e.props)}"
        for e in m.edges
    ]
    out = f"CREATE PROPERTY GRAPH {quoted(m.name)}\nVERTEX TABLES (\n" + ",\n".join(vertices) + "\n)"
    return out + ("\nEDGE TABLES (\n" + ",\n".join(edges) + "\n)" if edges else "") + ";"
