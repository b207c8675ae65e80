"""Registered queries against their SQL twins. All of them with TIDELOG_ALL=1, otherwise a sample of every family."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SAMPLE = ["scan_multi_part", "sink_predictions", "maturity_filter", "factorize_context", "context_sketch", "persist_state",
          "effective_key", "decay_rule", "rate_expert_matured", "window_report", "day_metrics", "group_metrics",
          "adaptive_window", "arw_daily", "learn_alpha", "hedge_discounted", "period_detect", "ops_block", "carryover",
          "time_of_day", "ons_stream", "anchored_share", "asof_history", "paired_bootstrap", "wilcoxon", "rolling_origin",
          "adaptation_metrics", "one_se_rule", "linear_frontier", "paced_auction_carry", "clicks_at_spend",
          "stream_ops", "leak_unmatured_tail"]
NAMES = list(ORACLES) if os.environ.get("TIDELOG_ALL") else SAMPLE


def _plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{value + 0.0:.6g}" if abs(value) > 1e-12 else "0"
    return str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(_plain(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf, duck, name):
    assert rows_of(QUERIES[name](spark, sf).toPandas()) == rows_of(duck.sql(ORACLES[name]).df())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
