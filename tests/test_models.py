import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelog.operators import adapter as ad
from tidelog.operators import blocks as bl
from tidelog.operators import checks as ck
from tidelog.operators import online as on
from tidelog.operators import features as fe
from tidelog.operators import history as hi
from tidelog.operators import learners as le
from tidelog.operators import logistic as lo
from tidelog.sources import logs, sinks


@pytest.fixture(scope="module")
def tallies(spark):
    rng = np.random.default_rng(8)
    n = 1500
    pdf = pd.DataFrame({"day": rng.integers(0, 5, n), "c": rng.choice(list("abc"), n), "g": rng.choice(list("xy"), n),
                        "early": True})
    pdf["click"] = (rng.random(n) < np.where(pdf["c"] == "a", 0.6, 0.3)).astype(int)
    return le.feature_tallies(spark.createDataFrame(pdf), ["c", "g"], ["early"])


def newton(x, n, k, weight, alpha):
    """Dense second-order fit of the objective; the last column of x is the intercept."""
    total, ridge = (n * weight).sum(), alpha * n[weight > 0].sum() / (n * weight).sum() * np.eye(x.shape[1])
    ridge[-1, -1] = 0
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        curve = (x.T * (weight * n * p * (1 - p))) @ x / total + ridge
        w = w - np.linalg.solve(curve + 1e-12 * np.eye(len(w)), x.T @ (weight * (n * p - k)) / total + ridge @ w)
    return w


def dense(pdf, columns):
    return np.hstack([*[pd.get_dummies(pdf[c]).reindex(columns=sorted(pdf[c].unique())).to_numpy(float) for c in columns], np.ones((len(pdf), 1))])


@pytest.mark.parametrize("group", [4_000_000, 1])
def test_all_windows_at_once_equal_dense_fits(spark, tallies, monkeypatch, group):
    """Windows, decayed rules and the width of a group change nothing: every fit is the optimum of its own objective."""
    monkeypatch.setattr(lo, "GROUP_VALUES", group)
    pdf = tallies.toPandas()
    x, n, k = dense(pdf, ["c", "g"]), pdf["n"].to_numpy(float), pdf["clicks"].to_numpy(float)

    def want(day, weight, alpha):
        w = newton(x, n, k, weight, alpha)
        test = (pdf["day"] == day).to_numpy()
        return {(c, g): p for c, g, p in zip(pdf["c"][test], pdf["g"][test], 1 / (1 + np.exp(-x[test] @ w)), strict=True)}

    bounds = spark.createDataFrame([(4, 0, 4), (3, 2, 3), (4, 3, 4)], "day int, lo int, hi int")
    got = le.fit_bank(tallies, bounds, ["c", "g"], alpha=1e-2).toPandas()
    for day, low, high in [(4, 0, 4), (3, 2, 3), (4, 3, 4)]:
        past = ((pdf["day"] >= low) & (pdf["day"] < high)).to_numpy(float)
        mine = got[(got["day"] == day) & (got["lo"] == low)]
        assert len(mine) == 6 and (mine["n_train"] == (n * past).sum()).all()
        for (c, g), p in want(day, past, 1e-2).items():
            assert abs(mine[(mine["c"] == c) & (mine["g"] == g)]["p"].iloc[0] - p) < 1e-4
    ruled = le.fit_rules(tallies, [2, 4], {"w2": (2, None), "d1": (None, 1.0)}, ["c", "g"]).toPandas()
    for day in (2, 4):
        age = day - pdf["day"].to_numpy()
        for name, weight in (("w2", ((age > 0) & (age <= 2)).astype(float)), ("d1", np.where(age > 0, 0.5 ** age, 0.0))):
            mine = ruled[(ruled["day"] == day) & (ruled["rule"] == name)]
            for (c, g), p in want(day, weight, le.ALPHA).items():
                assert abs(mine[(mine["c"] == c) & (mine["g"] == g)]["p"].iloc[0] - p) < 1e-4


def test_wide_hashes_with_many_values(spark):
    """More distinct values than a piece of sums holds, hashed at 2^18, against a dense fit."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"day": rng.integers(0, 2, 3000), "c": [f"v{i}" for i in rng.integers(0, 700, 3000)], "click": rng.integers(0, 2, 3000)})
    t = le.feature_tallies(spark.createDataFrame(pdf), ["c"])
    got = le.fit_bank(t, spark.createDataFrame([(1, 0, 1)], "day int, lo int, hi int"), ["c"], alpha=1e-3).toPandas()
    rows = t.toPandas()
    rows["at"] = [int(hashlib.md5(f"c={v}".encode()).hexdigest()[17:], 16) % 2 ** 18 for v in rows["c"]]  # a few values share a position
    x, n, k = dense(rows, ["at"]), rows["n"].to_numpy(float), rows["clicks"].to_numpy(float)
    w = newton(x, n, k, (rows["day"] == 0).to_numpy(float), 1e-3)
    want = dict(zip(rows["c"], 1 / (1 + np.exp(-x @ w)), strict=True))
    assert len(got) == (rows["day"] == 1).sum() and max(abs(p - want[c]) for c, p in zip(got["c"], got["p"], strict=True)) < 1e-4


def test_no_fit_on_one_class_or_empty_history(spark):
    rows = [(0, "a", True, 5, 0), (1, "a", True, 4, 2), (2, "a", True, 4, 1)]
    t = spark.createDataFrame(rows, "day int, c string, early boolean, n long, clicks long")
    bounds = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (2, 0, 2)], "day int, lo int, hi int")
    assert {r["day"] for r in le.fit_bank(t, bounds, ["c"]).collect()} == {2}
    prior = {r["day"]: r["p"] for r in le.fit_bank(t, bounds, ["c"], matured=True, prior_fallback=True).collect()}
    assert prior[0] == 0.5 and prior[1] == 0.0
    ruled = {r["day"]: r["p"] for r in le.fit_rules(t, [0, 1, 2], {"all": (None, None)}, ["c"]).collect()}
    assert ruled[0] is None and ruled[1] is None and abs(ruled[2] - 2 / 9) < 1e-4
    assert le.fit_bank(t.limit(0), bounds, ["c"]).collect() == []


def test_matured_windows_leave_out_the_tail(spark):
    rows = [(0, "a", True, 10, 5), (0, "a", False, 10, 0), (1, "a", True, 10, 9), (1, "a", False, 10, 1), (2, "a", True, 4, 1)]
    t = spark.createDataFrame(rows, "day int, c string, early boolean, n long, clicks long")
    bounds = spark.createDataFrame([(2, 0, 2)], "day int, lo int, hi int")
    r = le.fit_bank(t, bounds, ["c"], matured=True).first()
    assert r["n_train"] == 30 and abs(r["p"] - 14 / 30) < 1e-4


def test_golden_sections_find_all_minima():
    at = np.array([0.7, 2.2, 0.0])
    got = le.golden_sections(lambda x: (x - at) ** 2, np.zeros(3), np.full(3, 3.0), 22)
    assert np.abs(got - at).max() < 1e-3


def test_forgetting_for_every_day(tallies):
    """A row for each day, nulls where history is short; the rate found beats a grid on the held-out days."""
    table, scored = le.fit_forgetting(tallies, [0, 1, 4], ["c", "g"], val_window=2, evaluations=10)
    rows = {r["t"]: r for r in table.collect()}
    assert set(rows) == {0, 1, 4} and rows[0]["eta"] is None and rows[1]["eta"] is None and 0 <= rows[4]["eta"] <= 3
    assert {r["t"] for r in scored.collect()} == {4} and scored.filter("p IS NULL").count() == 0
    pdf = tallies.toPandas()
    x, n, k = dense(pdf, ["c", "g"]), pdf["n"].to_numpy(float), pdf["clicks"].to_numpy(float)
    day = pdf["day"].to_numpy()

    def loss(eta):
        w = newton(x, n, k, np.where(day < 2, np.exp(-eta * (4 - day)), 0.0), le.ALPHA)
        held = (day >= 2) & (day < 4)
        p = 1 / (1 + np.exp(-x[held] @ w))
        return -(k[held] * np.log(p) + (n - k)[held] * np.log(1 - p)).sum() / n[held].sum()

    assert loss(rows[4]["eta"]) <= min(map(loss, np.linspace(0, 3, 13))) + 2e-4  # the loss is not quite unimodal


def test_rate_bank_windows_by_hand(spark):
    cells = spark.createDataFrame([("a", 0, 10, 4, 2, 1), ("a", 1, 5, 0, 1, 0), ("a", 3, 2, 2, 0, 0)],
                                  "campaign string, day int, n long, clicks long, n_tail long, k_tail long")
    got = {r["day"]: r for r in hi.rate_bank(cells, ["campaign"]).collect()}
    assert got[0]["expanding"] == 0.4 and got[3]["roll1"] == 0.4
    assert abs(got[3]["roll3"] - (4 + 0.8) / 17) < 1e-12 and abs(got[1]["roll1"] - 4.8 / 12) < 1e-12
    late = {r["day"]: r for r in hi.rate_bank(cells, ["campaign"], matured=True).collect()}
    assert abs(late[1]["roll1"] - (3 + 0.8) / 10) < 1e-12 and late[3]["expanding"] == got[3]["expanding"]


def test_decayed_bank_matches_direct_sum(spark):
    days = {0: (10, 4), 1: (5, 0), 4: (8, 3)}
    cells = spark.createDataFrame([("a", d, n, k) for d, (n, k) in days.items()], "campaign string, day int, n long, clicks long")
    got = {r["day"]: r["decay3"] for r in hi.decayed_bank(cells, ["campaign"]).collect()}
    for t in days:
        w = {d: 2 ** (-(t - d) / 3) for d in days if d < t}
        k, n = sum(w[d] * days[d][1] for d in w), sum(w[d] * days[d][0] for d in w)
        assert abs(got[t] - (k + 0.8) / (n + 2)) < 1e-12


def test_learned_forgetting_finds_the_grid_minimum(spark):
    rng = np.random.default_rng(3)
    rows = [("c%d" % c, d, 200, int(rng.binomial(200, 0.2 + 0.05 * ((d + c) % 7)))) for c in range(3) for d in range(14)]
    cells = spark.createDataFrame(rows, "campaign string, day int, n long, clicks long")
    eta = hi.learn_forgetting(cells, ["campaign"], [12]).first()["eta"]
    grid = spark.createDataFrame([(12, 9, float(e)) for e in [eta, *np.linspace(0, 3, 16)]], "t int, upto int, eta double")
    loss = {r["eta"]: r["loss"] for r in hi.forgetting_losses(cells, ["campaign"], grid).collect()}
    assert loss[eta] <= min(loss.values()) + 1e-4


@pytest.fixture(scope="module")
def learner(spark):
    rng = np.random.default_rng(6)
    n = 400
    pdf = pd.DataFrame({"row_id": np.arange(n), "day": rng.integers(0, 3, n), "sec": rng.integers(0, 86400, n),
                        "q": rng.uniform(0.2, 0.6, n), "campaign": rng.integers(0, 4, n)})
    pdf["click"] = (rng.random(n) < pdf["q"]).astype(int)
    rows = spark.createDataFrame(pdf).withColumn("sketch", fe.signed_sketch(["campaign"], 2))
    return on.learner_rows(rows, 3600, 1800, 2)


def test_block_jobs_follow_the_definition(learner):
    got = {(r["day"], r["block"]): np.array(r["w"]) for r in on.weight_path(learner, 3600, 4, 1.0).collect()}
    pdf = learner.toPandas()
    for day, part in pdf.groupby("day"):
        phi, w, step = on._phi(part, 4), np.zeros_like(got[(day, 0)]), 0
        for block in range(24):
            assert np.allclose(got[(day, block)], w, atol=1e-9) and np.linalg.norm(w) <= 1 + 1e-9
            new = (part["upd"] == block).to_numpy()
            if new.any():
                step += 1
                resid = 1 / (1 + np.exp(-(part["z"].to_numpy()[new] + phi[new] @ w))) - part["click"].to_numpy()[new]
                w = w - phi[new].T @ resid / new.sum() / np.sqrt(step)
                w = w / max(1.0, np.linalg.norm(w))


def test_learner_starts_at_the_frozen_prediction(learner):
    path = on.weight_path(learner, 3600, 4, 1.0)
    out = on.predict(learner, path, 4).join(learner.select("row_id", "z", "block"), "row_id").filter("block = 0").collect()
    for r in out:
        assert abs(r["p"] - 1 / (1 + np.exp(-r["z"]))) < 1e-9


def test_tokens_and_ablations(spark):
    rows = spark.createDataFrame([(0, 0, 100, 1, 0.5, [1.0, 0.0]), (1, 0, 200, 0, 0.25, [0.0, 1.0])],
                                 "row_id long, day int, sec int, click int, q double, sketch array<double>")
    tokens = bl.block_tokens(rows, 43200, 2)
    got = {r["block"]: r["u"] for r in tokens.collect()}
    assert got[1] == [0.0] * 11
    assert np.allclose(got[0][:3], [np.log(3), 0.5, 0.375]) and np.allclose(got[0][9:], [0.25, -0.125])
    plain = bl.ablate(tokens, "label_free_history", 2).filter("block = 0").first()["u"]
    assert plain[1] == plain[4] == plain[9] == 0.0 and plain[2] == got[0][2]
    assert not any(bl.ablate(tokens, "no_history", 2).filter("block = 0").first()["u"])


def test_ewma_recursion(spark):
    u = [[1.0], [4.0], [2.0]]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(u)], "day int, block int, u array<double>")
    got = sorted((r["block"], r["e2"][0], r["prev"][0], r["diff"][0]) for r in bl.causal_summary(df).collect())
    keep, acc = 0.5 ** 0.25, 1.0
    for i, x in enumerate(u):
        acc = x[0] if i == 0 else (1 - keep) * x[0] + keep * acc
        assert abs(got[i][1] - acc) < 1e-12
        assert got[i][2] == (u[i - 1][0] if i else 0.0) and got[i][3] == x[0] - got[i][2]


def test_delimited_parts_are_read_with_the_declared_schema(spark, tmp_path):
    for part, line in (("a", "90000\t5\t1\t7\t0.5\n"), ("b", "10\t4\t0\t8\t0.25\n")):
        (tmp_path / f"{part}.tsv").write_text("timestamp\tcampaign\tclick\tcat1\tcost\n" + line)
    got = {(r["day"], r["sec"], r["click"]) for r in logs.delimited_log(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")]).collect()}
    assert got == {(1, 3600, 1), (0, 10, 0)}


def test_sources_and_leak_guard(spark, sf):
    with pytest.raises(KeyError):
        logs.source("nope", spark, sf)
    with pytest.raises(ValueError):
        logs.require_prebid(["campaign", "click"])
    assert "click" not in logs.prebid(logs.events_log(spark, sf)).columns


def test_resume_and_alignment(spark, tmp_path):
    path = str(tmp_path / "t")
    todo = spark.createDataFrame([(1, 0), (2, 0)], "origin int, seed int")
    assert sinks.missing_only(todo, spark, path, ["origin", "seed"]).count() == 2
    sinks.write_partitions(todo.filter("origin = 1").withColumn("p", F.lit(0.5)), path, ["origin", "seed"])
    assert [r["origin"] for r in sinks.missing_only(todo, spark, path, ["origin", "seed"]).collect()] == [2]
    sinks.write_partitions(todo.filter("origin = 2").withColumn("p", F.lit(0.7)), path, ["origin", "seed"])
    assert sinks.read_cells(spark, path).count() == 2
    pred = spark.createDataFrame([(1,), (1,), (9,)], "row_id int")
    log = spark.createDataFrame([(1,), (2,)], "row_id int")
    assert {r["problem"] for r in sinks.misaligned(pred, log).collect()} == {"not in log", "no prediction", "predicted twice"}


def test_differing_sees_changes_and_missing_rows(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, None)], "k int, v double")
    b = spark.createDataFrame([(1, 0.5), (2, 0.6), (3, None), (4, 0.1)], "k int, v double")
    got = {r["k"]: r["changed"] for r in ck.differing(a, b, ["k"], ["v"]).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True}


def test_rolling_adapter_follows_the_definition(spark, learner):
    """Every fit is the optimum on the days before; selection by inner days and one standard error; losses of the day itself."""
    settings = [ad.Setting(c, r) for c in (4, 6) for r in (0.5, 0.05)]
    got = {r["day"]: r for r in ad.rolling_adapter(learner, settings, inner=2).collect()}
    pdf = learner.toPandas()
    days = sorted(pdf["day"].unique())

    def loss(margin, y):
        p = np.clip(1 / (1 + np.exp(-margin)), 1e-6, 1 - 1e-6)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    def fit(past, setting):
        phi, z, y = on._phi(past, setting.cross), past["z"].to_numpy(), past["click"].to_numpy()
        w = np.zeros(phi.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-(z + phi @ w)))
            curve = (phi.T * (p * (1 - p))) @ phi / len(y) + setting.reg * np.eye(len(w))
            w = w - np.linalg.solve(curve, phi.T @ (p - y) / len(y) + setting.reg * w)
        return w

    mean = np.full((len(days), len(settings)), np.nan)
    blank = mean.copy()
    for i, d in enumerate(days):
        today = pdf[pdf["day"] == d]
        y, z = today["click"].to_numpy(), today["z"].to_numpy()
        empty = today.assign(s=[np.zeros(len(s)) for s in today["s"]])
        for j, setting in enumerate(settings):
            w = fit(pdf[pdf["day"] < d], setting) if i else np.zeros(on._phi(today, setting.cross).shape[1])
            mean[i, j] = loss(z + on._phi(today, setting.cross) @ w, y)
            blank[i, j] = loss(z + on._phi(empty, setting.cross) @ w, y)
        assert abs(got[d]["loss_frozen"] - loss(z, y)) < 1e-9 and got[d]["n"] == len(y)
        folds = mean[max(1, i - 2):i]
        if not len(folds):
            assert got[d]["cross"] is None and got[d]["loss"] is None
            continue
        score = folds.mean(axis=0)
        best = score.argmin()
        slack = folds[:, best].std(ddof=1) / np.sqrt(len(folds)) if len(folds) > 1 else 0
        pick = min((j for j in range(len(settings)) if score[j] <= score[best] + slack), key=lambda j: (settings[j].cross, -settings[j].reg))
        assert (got[d]["cross"], got[d]["reg"], got[d]["n_inner"]) == (settings[pick].cross, settings[pick].reg, len(folds))
        assert abs(got[d]["loss"] - mean[i, pick]) < 1e-6 and abs(got[d]["loss_no_history"] - blank[i, pick]) < 1e-6
