"""Registered queries of the risk engine against their SQL: a sample, or with ALL_QUERIES set all of them (nine minutes)."""

import os

import duckdb
import pytest

from veracast import queries as risk

DIR = "/root/testdata/sf0.001"
SAMPLE = ("text_stats", "domain_parts", "dedup_messages", "text_clusters", "author_features", "message_scores", "final_scores_semantic", "score_bands")
NAMES = sorted(risk.oracle_sql()) if os.environ.get("ALL_QUERIES") else SAMPLE


def rows(df):
    show = lambda x: None if x is None or x != x else f"{float(x):.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(str, map(show, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_equal(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    assert rows(risk.queries()[name](spark, DIR).toPandas()) == rows(con.execute(risk.oracle_sql()[name]).fetchdf())
