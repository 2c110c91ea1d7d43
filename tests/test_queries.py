"""Every registered query of the catalog engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from lodestone import operator_queries, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
RUN = queries.queries() | operator_queries.QUERIES
SQL = queries.oracle_sql() | operator_queries.ORACLES


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda x: "-" if x is None else f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return [columns[i] for i in order], sorted([tuple(text(r[i]) for i in order) for r in rows])


@pytest.mark.parametrize("name", sorted(RUN))
def test_against_sql(spark, sf_dir, name):
    df = RUN[name](spark, sf_dir)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = db.sql(SQL[name])
    assert canonical(rows, df.columns) == canonical(out.fetchall(), out.columns)


def test_pattern_filters_reach_the_scan(spark, sf_dir):
    """A star of patterns is one scan, its constant a pushed filter."""
    df = RUN["family_members"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_brand,Brand#2)" in plan and plan.count("FileScan") == 2
