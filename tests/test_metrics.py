import numpy as np
import pandas as pd

from tidelog.operators import metrics as me


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def brute_ap(y, p):
    total, hits, out = 0, 0, 0.0
    for s in sorted(set(p), reverse=True):
        k, n = y[p == s].sum(), (p == s).sum()
        total, hits = total + n, hits + k
        out += k * hits / total
    return out / y.sum()


def test_ranking_metrics_match_brute_force(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(400), 2)
    y = (rng.random(400) < p).astype(int)
    df = me.from_records(spark.createDataFrame(pd.DataFrame({"m": "a", "y": y, "p": p})))
    for exact in (False, True):
        r = me.ranking_metrics(df, ["m"], exact_slices=exact).first()
        assert abs(r["roc_auc"] - brute_auc(y, p)) < 1e-12
        assert abs(r["pr_auc"] - brute_ap(y, p)) < 1e-12


def test_one_class_gives_null(spark):
    df = me.from_records(spark.createDataFrame([("a", 1, 0.3), ("a", 1, 0.7), ("b", 0, 0.1)], "m string, y int, p double"))
    for r in me.ranking_metrics(df, ["m"]).collect():
        assert r["roc_auc"] is None and r["pr_auc"] is None


def test_ece_separates_calibrated_from_shifted(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0.2, 0.6, 20000)
    y = (rng.random(20000) < p).astype(int)
    pdf = pd.concat([pd.DataFrame({"m": "good", "y": y, "p": p}), pd.DataFrame({"m": "off", "y": y, "p": p + 0.2})])
    got = {r["m"]: r["ece"] for r in me.calibration_error(me.from_records(spark.createDataFrame(pdf)), ["m"]).collect()}
    assert got["good"] < 0.02 and got["off"] > 0.1


def test_tally_equals_rows(spark):
    rows = me.from_records(spark.createDataFrame([("a", 1, 0.3)] * 3 + [("a", 0, 0.3)] * 5, "m string, y int, p double"))
    tally = spark.createDataFrame([("a", 8, 3, 0.3)], "m string, n long, clicks long, p double")
    a, b = me.mean_losses(rows, ["m"]).first(), me.mean_losses(tally, ["m"]).first()
    assert abs(a["log_loss"] - b["log_loss"]) < 1e-12 and abs(a["brier"] - b["brier"]) < 1e-12


def test_keep_last(spark):
    old = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.6)], "m string, day int, loss double")
    new = spark.createDataFrame([("b", 1, 0.4)], "m string, day int, loss double")
    got = {(r["m"], r["loss"]) for r in me.keep_last(old, new, ["m", "day"]).collect()}
    assert got == {("a", 0.5), ("b", 0.4)}
