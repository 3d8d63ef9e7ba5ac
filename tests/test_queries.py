"""Every query against its SQL, in the plain form and in the form for large inputs."""

import glob
import os

import duckdb
import pytest

from tidewright import queries as Q
from tidewright.plans import frames


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _same(spark, db, small, name):
    df = Q.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    want = sorted(db.execute(f"SELECT {', '.join(cols)} FROM ({Q.SQL[name]})").fetchall(), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(spark, db, small, name):
    _same(spark, db, small, name)


LARGE = ["summary_stats", "value_at", "distribution_percentiles", "rate_of_change_ties", "data_quality_flatlines", "data_quality_gaps_top", "find_events_outside", "compare_to_baseline_episodes", "sparkline", "outlier_bounds", "resample_median", "correlate", "correlate_bucket"]


@pytest.mark.parametrize("name", LARGE)
def test_query_in_the_form_for_large_inputs(spark, db, small, name, monkeypatch):
    monkeypatch.setattr(frames, "SMALL", 0)
    monkeypatch.setattr(frames, "ACCURACY", 50)
    monkeypatch.setattr(frames, "MARGIN", 4 / 50)
    _same(spark, db, small, name)
