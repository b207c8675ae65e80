import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelog.operators import gates as ga
from tidelog.plans import gate_queries as gq

RNG = np.random.default_rng(9)
ROWS = 40
X, P = RNG.normal(size=(ROWS, 3)), RNG.uniform(0.1, 0.9, (ROWS, 3))
N = RNG.integers(1, 5, ROWS).astype(float)
K = np.minimum(RNG.integers(0, 3, ROWS), N).astype(float)
G = RNG.integers(0, 2, ROWS)


def numeric(f, theta, eps=1e-6):
    out = np.zeros_like(theta)
    for i in range(len(theta)):
        a, b = theta.copy(), theta.copy()
        a[i] += eps
        b[i] -= eps
        out[i] = (f(a) - f(b)) / (2 * eps)
    return out


def test_pair_gradient():
    spec = ga.GateSpec("p", "pair", (0, 1, 2), (0, 1), entropy=0.1)
    theta = RNG.normal(size=4) * 0.3

    def objective(t):
        a = 1 / (1 + np.exp(-(np.hstack([X, np.ones((ROWS, 1))]) @ t)))
        m = (1 - a) * P[:, 1] + a * P[:, 0]
        return (-(K * np.log(m) + (N - K) * np.log(1 - m)) + 0.1 * N * (a * np.log(a) + (1 - a) * np.log(1 - a))).sum()

    got = ga.pair_sums(theta, X, P[:, :2], N, K, spec)
    assert np.allclose(got["grad"], numeric(objective, theta), rtol=1e-5, atol=1e-5)
    slope = numeric(lambda t: (N / (1 + np.exp(-(np.hstack([X, np.ones((ROWS, 1))]) @ t)))).sum(), theta)
    assert np.allclose(got["smooth"], slope, rtol=1e-5, atol=1e-5)


def test_multi_gradient():
    spec = ga.GateSpec("m", "multi", (0, 1, 2), (0, 1, 2), entropy=0.1)
    theta = RNG.normal(size=12) * 0.3
    x1 = np.hstack([X, np.ones((ROWS, 1))])

    def softmax(t):
        z = np.exp(x1 @ t.reshape(4, 3))
        return z / z.sum(axis=1, keepdims=True)

    def objective(t):
        q = softmax(t)
        m = (P * q).sum(axis=1)
        return (-(K * np.log(m) + (N - K) * np.log(1 - m)) + 0.1 * N * (q * np.log(q)).sum(axis=1)).sum()

    got = ga.multi_sums(theta, X, P, N, K, spec)
    assert np.allclose(got["grad"], numeric(objective, theta), rtol=1e-5, atol=1e-5)
    for h in range(3):
        assert np.allclose(got["smooth"][h], numeric(lambda t: (N * softmax(t)[:, h]).sum(), theta), rtol=1e-5, atol=1e-5)


def test_persistence_gradient():
    spec = ga.PersistSpec("a", columns=(0, 1, 2), experts=(0, 1, 2), entropy=0.1, per_example=True)
    base = {"w": RNG.normal(size=12) * 0.3, "xi": RNG.normal(size=4) * 0.3, "m": np.array([0.2, 0.5, 0.3]), "logit": 0.4}

    def objective(**change):
        par = {**base, **change}
        _, q, _, _, pi = ga.persist_weights(spec, par, X, 3, G)
        m = (P * pi).sum(axis=1)
        return (-(K * np.log(m) + (N - K) * np.log(1 - m)) + 0.1 * N * (q * np.log(q)).sum(axis=1)).sum()

    got = ga.persist_sums(base, X, P, N, K, G, spec)
    assert np.allclose(got["grad"], numeric(lambda t: objective(w=t), base["w"]), rtol=1e-5, atol=1e-5)
    assert np.allclose(got["xi"], numeric(lambda t: objective(xi=t), base["xi"]), rtol=1e-5, atol=1e-5)
    assert np.allclose(got["logit"], numeric(lambda t: objective(logit=t[0]), np.array([0.4]))[0], rtol=1e-5)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 160
    p = rng.uniform(0.1, 0.7, (n, 3))
    pdf = pd.DataFrame({"row_id": np.arange(n), "day": np.repeat(range(4), n // 4), "n": 1.0,
                        "clicks": (rng.random(n) < p[:, 0]).astype(float), "grp01": rng.integers(0, 2, n),
                        "early": rng.random(n) < 0.9, **{f"p{i}": p[:, i] for i in range(3)}, "c": rng.normal(size=n)})
    rows = spark.createDataFrame(pdf)
    cols = [F.col(f"p{i}") for i in range(3)]
    return ga.gate_table(rows, [*cols, F.col("c")], cols, ["row_id"])


SPECS = [ga.GateSpec("pair", "pair", (0, 1, 3), (0, 2)), ga.GateSpec("multi", "multi", (0, 1, 2, 3), (0, 1, 2), smooth=0.05)]
STATE = {d: {"losses": [0.1 * d] * 5, "disagreement": 0.05, "ctr": 0.3, "jump": 0.01, "norm_t": d / 4} for d in range(4)}
PERSIST = [ga.PersistSpec("a", columns=(0, 1, 2, 3), experts=(0, 1, 2)),
           ga.PersistSpec("x", columns=(0, 1, 2, 3), experts=(0, 1, 2), per_example=True, beta_var=0.5, per_group=True)]


def test_first_day_is_neutral_and_the_future_does_not_leak(spark, table):
    deployed = ga.train_gates(table, SPECS)
    assert all(not t.any() for t in deployed[0])
    flipped = table.withColumn("clicks", F.when(F.col("day") >= 2, F.col("n") - F.col("clicks")).otherwise(F.col("clicks")))
    other = ga.train_gates(flipped, SPECS)
    for a, b in zip(deployed[2], other[2]):
        assert np.allclose(a, b)
    assert not np.allclose(deployed[3][1], other[3][1])


def test_unmatured_tail_reaches_the_day_after_next(table):
    spec = [ga.PersistSpec("m", columns=(0, 1, 2, 3), experts=(0, 1, 2), matured=True)]
    tail = (F.col("day") == 1) & ~F.col("early")
    flipped = table.withColumn("clicks", F.when(tail, F.col("n") - F.col("clicks")).otherwise(F.col("clicks")))
    a, b = (ga.train_persistence(t, spec, STATE) for t in (table, flipped))
    same = [np.allclose(x["params"]["w"], y["params"]["w"], atol=1e-12) for x, y in zip(a, b)]
    assert same == [True, True, True, False]


def test_fixed_half_persistence_with_uniform_gate_stays_uniform(table):
    spec = [ga.PersistSpec("u", columns=(0,), experts=(0, 1, 2), adaptive=False, fixed_beta=0.5, uniform_q=True)]
    for t in ga.train_persistence(table, spec, STATE):
        assert np.allclose(t["pi"], [1 / 3] * 3)
    out = ga.predict_persistence(table, ga.train_persistence(table, spec, STATE), ["row_id"])
    joined = out.join(table.select("row_id", "p"), "row_id")
    worst = joined.select(F.max(F.abs(F.col("p_u") - (F.col("p")[0] + F.col("p")[1] + F.col("p")[2]) / 3))).first()[0]
    assert worst < 1e-12


def test_simplex_weights_follow_the_definition(spark):
    rng = np.random.default_rng(1)
    frames = []
    for origin in (3, 4):
        good = rng.uniform(0.1, 0.9, 60).round(2)
        frames.append(pd.DataFrame({"origin": origin, "good": good, "bad": 1 - good, "n": 100,
                                    "clicks": (100 * good).round().astype(int)}))
    fitted = ga.fit_simplex(spark.createDataFrame(pd.concat(frames)), ["good", "bad"], "origin", max_iter=40)
    for pdf in frames:
        got = fitted[int(pdf["origin"].iloc[0])]
        p = np.repeat(pdf[["good", "bad"]].to_numpy(), 100, axis=0)
        y = np.concatenate([np.r_[np.ones(k), np.zeros(100 - k)] for k in pdf["clicks"]])
        w, before = np.full(2, 0.5), np.inf
        for t in range(1, 41):
            m = np.clip(p @ w, 1e-12, 1 - 1e-12)
            g = (p * (m - y)[:, None]).mean(axis=0)
            w = w * np.exp(-4.0 / np.sqrt(t) * g)
            w = w / w.sum()
            loss = -(y * np.log(m) + (1 - y) * np.log(1 - m)).mean()
            if abs(before - loss) < 1e-9:
                break
            before = loss
        assert np.allclose(got, w, atol=1e-9) and got[0] > got[1]


def test_available_inputs_leave_out_the_tail_that_has_not_arrived(spark):
    """The tail of day 1 is unknown on day 2 and known on day 3."""
    rows = [(d, early, 10, k) for d, early, k in ((0, True, 4), (0, False, 2), (1, True, 5), (1, False, 1), (2, True, 3),
                                                  (2, False, 3), (3, True, 2))]
    df = spark.createDataFrame(rows, "day int, early boolean, n long, clicks long").select(
        "*", *[F.lit(0.2 + 0.1 * i).alias(e) for i, e in enumerate(gq.EXPERTS)])
    flipped = df.withColumn("clicks", F.when((F.col("day") == 1) & ~F.col("early"), F.col("n") - F.col("clicks"))
                            .otherwise(F.col("clicks")))
    a, b = ({r["day"]: r for r in gq.available_inputs(x, 3).collect()} for x in (df, flipped))
    assert a[1] == b[1] and a[2] == b[2] and a[3]["loss_jump"] != b[3]["loss_jump"]
    assert a[2]["recent_ctr"] == 0.5 and a[1]["recent_ctr"] == 0.4 and a[0]["recent_ctr"] == 0.0


def test_time_only_persistence_knows_the_time_on_the_first_day(table):
    spec = [ga.PersistSpec("t", columns=(0,), experts=(0, 1, 2), state=(8,))]
    late = {d: {**row, "norm_t": 0.5 + d / 8} for d, row in STATE.items()}
    first = ga.train_persistence(table, spec, late)
    plain = ga.train_persistence(table, spec, STATE)
    assert abs(first[0]["beta"] - plain[0]["beta"]) < 1e-12  # the weight of the time is still zero
    assert abs(first[1]["beta"] - plain[1]["beta"]) > 1e-9


def test_near_global_variant_has_almost_no_spread(spark, sf):
    out = {r["method"]: r for r in gq.group_beta_gap(spark, sf).collect()}
    assert out["near_global"]["spread"] <= out["per_example"]["spread"] + 1e-6
