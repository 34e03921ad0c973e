"""Command line: check, convert and format mappings, and run an algorithm over a folder of Parquet tables."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from relgraph.plans import mapping as M, pgq


def read_mapping(path: str) -> M.GraphMapping:
    text = Path(path).read_text()
    return pgq.parse(text) if path.endswith(".sql") else M.from_json(text) if path.endswith(".json") else M.from_yaml(text)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="relgraph", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("check", "say what is wrong with a mapping"), ("to-sql", "print it as SQL/PGQ"), ("to-yaml", "print it as YAML"), ("format", "print it in lower case")):
        sub.add_parser(name, help=what).add_argument("mapping")
    run = sub.add_parser("run", help="run an algorithm")
    run.add_argument("mapping")
    run.add_argument("tables", help="a folder with a Parquet table of each name")
    run.add_argument("algorithm")
    run.add_argument("--args", default="{}", help="JSON of keyword arguments")
    run.add_argument("--out", help="write the result there as Parquet; else show it")
    a = p.parse_args(argv)
    m = read_mapping(a.mapping)
    if a.command == "check":
        problems = M.check(m)
        print("\n".join(problems) or "no problem")
        return int(bool(problems))
    if a.command != "run":
        print(pgq.render(m) if a.command == "to-sql" else M.to_yaml(M.folded(m) if a.command == "format" else m))
        return 0
    from pyspark.sql import SparkSession

    from relgraph.session import Session

    spark = SparkSession.builder.appName("relgraph").getOrCreate()
    session = Session(spark).define_graph(m)
    names = {x.table for x in (*session.mapping.vertices, *session.mapping.edges)}
    out = session.load_tables({t: spark.read.parquet(f"{a.tables}/{t}.parquet") for t in names}).run(a.algorithm, **json.loads(a.args))
    if a.out:
        out.write.parquet(a.out)
    else:
        out.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
