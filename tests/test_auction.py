import numpy as np
import pandas as pd
import pytest

from tidelog.operators import auction as au


def bids(spark, pdf):
    pdf = pdf.assign(conversion=0, attribution=0, cpo=0.2)
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def toy():
    rng = np.random.default_rng(2)
    n = 600
    p = rng.uniform(0.05, 0.6, n)
    return pd.DataFrame({"m": "x", "row_id": np.arange(n), "day": rng.integers(0, 6, n), "p": p,
                         "click": (rng.random(n) < p).astype(int), "cost": np.round(rng.lognormal(0, 1, n), 3) + 0.01})


def test_frontier_matches_every_scale(spark, toy):
    got = au.linear_frontier(bids(spark, toy), ["m"]).toPandas().sort_values("step")
    ratio = toy["cost"] / toy["p"]
    scales = np.geomspace(np.quantile(ratio, 0.001), np.quantile(ratio, 0.999), 40)
    for s, (_, r) in zip(scales, got.iterrows()):
        won = s * toy["p"] >= toy["cost"]
        assert r["clicks"] == toy["click"][won].sum() and abs(r["spend"] - toy["cost"][won].sum()) < 1e-6


def test_zero_predictions_never_win(spark, toy):
    got = au.linear_frontier(bids(spark, toy.assign(p=toy["click"].astype(float))), ["m"]).toPandas()
    assert (got["clicks"] == got["impressions"]).all()


def test_equal_efficiency_is_taken_in_row_order_up_to_the_exact_budget(spark):
    pdf = pd.DataFrame({"m": "x", "row_id": range(8), "day": 0, "p": 0.5, "click": [1, 0] * 4, "cost": 1.0})
    rows = bids(spark, pdf)
    ranked = au.ranked_by_efficiency(rows, ["m"])
    day = au.paced_auction(ranked, ["m"], au.daily_allowance(rows, ["m"], 0.375)).first()
    assert day["impressions"] == 3 and day["spend"] == 3.0 and day["clicks"] == 2 and day["allowance_after"] == 0.0


@pytest.mark.parametrize("carry", [False, True])
def test_pacing_matches_definition(spark, toy, carry):
    rows = bids(spark, toy)
    ranked, allow = au.ranked_by_efficiency(rows, ["m"]), au.daily_allowance(rows, ["m"], 0.2)
    run = au.paced_auction_carry if carry else au.paced_auction
    days = run(ranked, ["m"], allow)
    got = {r["day"]: r for r in days.collect()}
    per, left = toy["cost"].sum() * 0.2 / toy["day"].nunique(), 0.0
    for day in sorted(toy["day"].unique()):
        now = left + per if carry else per
        part = toy[toy["day"] == day].assign(e=lambda x: -x["p"] / x["cost"]).sort_values(["e", "row_id"])
        taken = part[part["cost"].cumsum() <= now]
        left = now - taken["cost"].sum()
        assert got[day]["impressions"] == len(taken) and abs(got[day]["allowance_after"] - left) < 1e-6
    total = au.paced_summary(days, ["m"], allow).first()
    assert total["violation"] == 0.0 and 0 < total["budget_used"] <= 1


def test_interpolation_on_flat_segments_and_ends(spark):
    fr = spark.createDataFrame([("x", 0, 1.0, 2), ("x", 1, 3.0, 6), ("x", 2, 3.0, 7), ("x", 3, 5.0, 7)],
                               "m string, step int, spend double, clicks long")
    goals = spark.createDataFrame([(0.5,), (1.0,), (2.0,), (3.0,), (4.0,), (9.0,)], "target double")
    open_ = {r["target"]: r["clicks_at"] for r in au.value_at_spend(fr, ["m"], goals).collect()}
    assert open_ == {0.5: None, 1.0: 2.0, 2.0: 4.0, 3.0: 7.0, 4.0: 7.0, 9.0: 7.0}
    shut = {r["target"]: (r["clicks_at"], r["lo"], r["hi"]) for r in au.value_at_spend(fr, ["m"], goals, True).collect()}
    assert shut[0.5] == (2.0, 1.0, 1.0) and shut[9.0] == (7.0, 5.0, 5.0)
