import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelog.operators.quantiles import exact_quantiles
from tidelog.session import attach, ensure_checkpoint_dir, running_total


def skewed(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"k": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n)), "id": np.arange(n),
                         "v": rng.integers(0, 9, n).astype(float), "o": rng.integers(0, 40, n)})


def test_running_total_with_a_hot_key(spark):
    pdf = skewed()
    out = running_total(spark.createDataFrame(pdf), ["k"], [F.col("o").desc(), F.col("id")], {"c": "v"}, slices=7)
    got = out.toPandas().sort_values("id")["c"].to_numpy()
    want = pdf.sort_values(["o", "id"], ascending=[False, True]).groupby("k")["v"].cumsum().sort_index().to_numpy()
    assert np.allclose(got, want)


def test_exact_quantiles_with_ties_and_skew(spark):
    pdf = skewed()
    pdf["x"] = np.where(pdf["v"] < 4, 1.0, np.exp(pdf["o"] / 3.0) + pdf["id"] * 1e-7)
    got = exact_quantiles(spark.createDataFrame(pdf), ["k"], "x", [0.001, 0.5, 0.77, 0.999], bins=8)
    for key, part in pdf.groupby("k"):
        assert np.allclose(got[(key,)], np.quantile(part["x"], [0.001, 0.5, 0.77, 0.999]), rtol=1e-12)


def test_exact_quantiles_of_negative_values(spark):
    pdf = pd.DataFrame({"x": np.linspace(-5, 5, 101)})
    assert np.allclose(exact_quantiles(spark.createDataFrame(pdf), [], "x", [0.0, 0.31, 1.0])[()],
                       np.quantile(pdf["x"], [0.0, 0.31, 1.0]))


@pytest.mark.parametrize("bound", [1, 100])
def test_attach_gives_the_same_rows_either_way(spark, bound):
    rows = spark.range(50).withColumn("k", F.col("id") % 5)
    state = spark.range(4).select(F.col("id").alias("k"), (F.col("id") * 10).alias("s"))
    got = {(r["id"], r["s"]) for r in attach(rows, state, ["k"], broadcast_rows=bound).collect()}
    assert got == {(i, (i % 5) * 10 if i % 5 < 4 else None) for i in range(50)}


def test_checkpoint_dir_is_read_from_the_session(spark):
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()
