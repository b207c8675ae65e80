import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.operators import daystats as ds

# ten day differences with zeros and one outlier; "few" has too few days for block resampling
TEN = [-0.002, 0.0, -0.001, 0.003, 0.0, -0.004, -0.002, 0.05, -0.003, -0.001]
FEW = [-0.1, 0.2, -0.3]


@pytest.fixture(scope="module")
def deltas(spark):
    rows = [("ten", i, 10 + i, v) for i, v in enumerate(TEN)] + [("few", i, 10, v) for i, v in enumerate(FEW)]
    return spark.createDataFrame(rows, "m string, day int, n int, delta double")


def test_bootstrap_brackets_the_mean_and_repeats(deltas):
    a = {r["m"]: r for r in ds.bootstrap_mean(deltas, ["m"], n_boot=300).collect()}
    b = {r["m"]: r for r in ds.bootstrap_mean(deltas, ["m"], n_boot=300).collect()}
    assert a == b
    assert abs(a["ten"]["mean"] - np.mean(TEN)) < 1e-12 and a["ten"]["lo"] < np.mean(TEN) < a["ten"]["hi"]


def test_block_bootstrap_needs_two_blocks(deltas):
    got = {r["m"]: r for r in ds.bootstrap_blocks(deltas, ["m"], n_boot=200).collect()}
    assert got["few"]["lo"] is None and got["few"]["hi"] is None
    assert got["ten"]["lo"] < got["ten"]["hi"]


def test_leave_one_out(deltas):
    got = {r["day"]: r["loo"] for r in ds.leave_one_out(deltas.filter("m = 'ten'"), ["m"]).collect()}
    for i in range(10):
        assert abs(got[i] - np.mean(np.delete(TEN, i))) < 1e-12


@pytest.mark.parametrize("k,n", [(0, 5), (2, 5), (5, 10), (10, 10), (30, 60)])
def test_sign_tests(spark, k, n):
    df = spark.createDataFrame([(k, n)], "k int, n int")
    r = df.select(*[c.alias(a) for a, c in ds.sign_tests(F.col("k"), F.col("n")).items()]).first()
    pmf = [math.comb(n, i) / 2 ** n for i in range(n + 1)]
    assert abs(r["p_two_sided"] - min(1.0, sum(p for p in pmf if p <= pmf[k] * (1 + 1e-7)))) < 1e-9
    assert abs(r["p_one_sided"] - sum(pmf[k:])) < 1e-9
    assert abs(r["p_floor"] - min(1, 2 * 0.5 ** n)) < 1e-12


def test_signed_rank_exact_and_normal(spark):
    exact = [1.1, -0.4, 2.3, 0.9, -3.1, 1.7, 0.2]
    rows = [("e", i, v) for i, v in enumerate(exact)] + [("t", i, v) for i, v in enumerate(TEN)]
    got = {r["m"]: r for r in ds.signed_rank(spark.createDataFrame(rows, "m string, day int, delta double"), ["m"]).collect()}
    ranks = np.argsort(np.argsort(np.abs(exact))) + 1
    w = min(ranks[np.array(exact) > 0].sum(), ranks[np.array(exact) < 0].sum())
    sums = [sum(j + 1 for j in range(7) if m >> j & 1) for m in range(128)]
    assert got["e"]["exact"] and abs(got["e"]["p"] - min(1, 2 * np.mean([s <= w for s in sums]))) < 1e-12
    z = np.array([v for v in TEN if v])
    r = np.array([np.mean([j + 1 for j, u in enumerate(sorted(np.abs(z))) if u == v]) for v in np.abs(z)])
    stat, n = min(r[z > 0].sum(), r[z < 0].sum()), len(z)
    _, ties = np.unique(np.abs(z), return_counts=True)
    var = n * (n + 1) * (2 * n + 1) / 24 - sum(t ** 3 - t for t in ties) / 48
    assert not got["t"]["exact"]
    assert abs(got["t"]["p"] - math.erfc(abs((stat - n * (n + 1) / 4) / math.sqrt(var)) / math.sqrt(2))) < 1e-10


def test_holm(spark):
    df = spark.createDataFrame([(0, "a", 0.01), (0, "b", 0.04), (0, "c", 0.03), (0, "d", 0.9)], "f int, m string, p double")
    got = {r["m"]: round(r["p_holm"], 10) for r in ds.holm(df, ["f"], "m").collect()}
    assert got == {"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.9}


def test_summary_has_one_row_per_key(deltas):
    got = {r["m"]: r for r in ds.summary(deltas, ["m"], n_boot=100).collect()}
    assert set(got) == {"ten", "few"} and got["ten"]["won"] == 6 and got["few"]["reverses"]
