"""Command line: answers a query file over graph files or a folder of tables, as CSV on stdout.

    python -m lodestone.ask QUERY.rq --graph a.nt b.ttl [--reason]
    python -m lodestone.ask QUERY.rq --tables SF_DIR
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from lodestone.operators.reason import owl_closure
from lodestone.plans.compiler import query
from lodestone.plans.graph import TripleGraph
from lodestone.plans.silver import silver_graph, star_tables
from lodestone.session import session
from lodestone.sources.readers import read_graph
from lodestone.sources.sinks import csv_text


def answer(spark: SparkSession, text: str, graphs: list[str], tables: str | None = None, reason: bool = False) -> str:
    """The answer of a query text as CSV. With `reason`, over the graph's closure."""
    if tables:
        return csv_text(query(silver_graph(star_tables(spark, tables)), text))
    rows = read_graph(spark, graphs)
    if reason:
        rows = owl_closure(rows)
    return csv_text(query(TripleGraph(rows.select("s", "p", "o", "o_kind")), text))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone.ask", description="Answers a query file as CSV.")
    parser.add_argument("query", type=Path)
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--graph", nargs="+", default=[], help="N-Triples and Turtle files, read as one graph")
    source.add_argument("--tables", help="folder of the tables")
    parser.add_argument("--reason", action="store_true", help="infer types and equal individuals first")
    args = parser.parse_args(argv)
    if args.reason and args.tables:
        parser.error("--reason needs --graph")
    sys.stdout.write(answer(session("ask"), args.query.read_text(), args.graph, args.tables, args.reason))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
