"""The driver contract: entry smoke, query registry, oracle parity on a sample."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert "throughput_rps" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 80


@pytest.mark.parametrize("name", ["m3_request_summary", "l7_option_scores", "a10_compare_variants",
                                  "t9_tfidf_topk", "g5_determinism", "c6_cached_scoring"])
def test_oracle_parity_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    want = con.execute(E.oracle_sql()[name]).df()
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)

    def norm(df):
        out = []
        for rec in df[cols].itertuples(index=False, name=None):
            out.append(tuple(None if (isinstance(v, float) and v != v) else
                             (round(v, 6) if isinstance(v, float) else (None if v is None else str(v)))
                             for v in rec))
        return sorted(out, key=repr)
    assert norm(got) == norm(want)
