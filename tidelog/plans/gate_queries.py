"""Queries: gates fitted online on the expert bank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import scoring as sc
from tidelog.functions import timeaxis as ta
from tidelog.operators import features as fe
from tidelog.operators import gates as ga
from tidelog.operators import history as hi
from tidelog.operators import metrics as me
from tidelog.operators import mixing as mx
from tidelog.operators import splits as sp
from tidelog.plans import fixtures as fx
from tidelog.plans.registry import query, r6
from tidelog.plans.sqlbase import EXPERTS
from tidelog.session import literal_rows

# The published grid of smoothness penalties.
SMOOTH_GRID = [0.0, 1e-4, 3e-4, 1e-3, 3e-3, 1e-2, 3e-2]
KEYS = ["campaign", "cat1", "early"]
# Positions in x: predictions, spread, time, recent losses, pair features, phase, context.
X_NAMES = [*EXPERTS, "spread", "norm_t", *[f"recent_{e}" for e in EXPERTS], "abs_diff", "diff", "sin_phase",
           "cos_phase", "ctx_campaign", "ctx_cat1"]
P_INDEX = {e: i for i, e in enumerate(EXPERTS)}


def _at(*names: str) -> tuple[int, ...]:
    return tuple(X_NAMES.index(n) for n in names)


MULTI = _at(*EXPERTS, "spread", "norm_t", *[f"recent_{e}" for e in EXPERTS])
CONTEXT = _at("ctx_campaign", "ctx_cat1")
PAIR = _at(hi.SHORT, hi.LONG, "abs_diff", "diff", "norm_t", f"recent_{hi.SHORT}", f"recent_{hi.LONG}")
ALL = tuple(range(len(EXPERTS)))
PAIR_GATE = ga.GateSpec("pair", "pair", PAIR + CONTEXT, (P_INDEX[hi.SHORT], P_INDEX[hi.LONG]))
MULTI_GATE = ga.GateSpec("multi", "multi", MULTI + CONTEXT, ALL)
STIFF_GATE = ga.GateSpec("stiff", "multi", MULTI + CONTEXT, ALL, smooth=0.1)
PERIODIC_GATE = ga.GateSpec("periodic", "multi", MULTI + _at("sin_phase", "cos_phase") + CONTEXT, ALL)


def available_inputs(rows: DataFrame, last_day: int) -> DataFrame:
    """Day-level inputs from labels that have arrived when the day starts, one row per calendar day.

    The latest earlier day counts without its late tail if it is yesterday and
    whole otherwise; the day before it is always whole. Without a label that has
    arrived, an input is zero.
    """
    n, k, early = F.col("n"), F.col("clicks"), F.col("early")
    gap = F.abs(F.col(hi.SHORT) - F.col(hi.LONG))

    def ratio(value, part):
        return F.try_divide(F.sum(F.when(part, value)), F.sum(F.when(part, n)))

    daily = rows.groupBy("day").agg(*[ratio(v, part).alias(f"{name}_{side}") for side, part in (
        ("all", F.lit(True)), ("early", early)) for name, v in [
        *[(e, sc.tally_loss(n, k, F.col(e))) for e in EXPERTS], ("dis", n * gap), ("ctr", k)]])
    order = Window.orderBy("day")  # one row per calendar day
    yesterday = F.lag("day").over(order) == F.col("day") - 1

    def last(name):
        return F.coalesce(F.when(yesterday, F.lag(f"{name}_early").over(order)).otherwise(
            F.lag(f"{name}_all").over(order)), F.lit(0.0))

    jump = F.greatest(*[F.abs(last(e) - F.lag(f"{e}_all", 2).over(order)) for e in EXPERTS])
    return daily.select("day", *[last(e).alias(f"recent_{e}") for e in EXPERTS], last("dis").alias("recent_disagreement"),
                        last("ctr").alias("recent_ctr"), F.coalesce(jump, F.lit(0.0)).alias("loss_jump"),
                        (F.col("day") / max(last_day, 1)).alias("norm_t"))


def feature_rows(spark, d, matured: bool = False) -> DataFrame:
    """Tallies per (day, campaign, cat1, maturity) with every gate input; identical rows are counted, not repeated."""
    log = fx.imp(spark, d).withColumn("early", ta.matured_by_midnight(F.col("sec")))
    log = log.withColumn("grp01", (F.col("grp") == "B").cast("int"))
    rows = fx.with_rates(hi.cell_counts(log, [*KEYS, "grp01"]), matured)
    losses = fx.day_losses(hi.long_bank(rows, EXPERTS, ["day", "n", "clicks"]))
    last = fx.last_day(spark, d)
    recent = fe.previous_day(losses, "expert", EXPERTS) if not matured else \
        available_inputs(rows, last).select("day", *[f"recent_{e}" for e in EXPERTS])
    rows = fe.multi_features(rows, recent, EXPERTS, last)
    period = mx.cycle_length(losses.filter(F.col("expert") == hi.LONG), 3, 25).select("day", "period")
    rows = rows.join(period, "day")
    sin, cos = sc.phase(F.col("day"), F.col("period"))
    diff = F.col(hi.SHORT) - F.col(hi.LONG)
    rows = rows.withColumns({"diff": diff, "abs_diff": F.abs(diff), "sin_phase": sin, "cos_phase": cos})
    return fe.max_normalised(rows, ["campaign", "cat1"])


def table(spark, d, matured: bool = False) -> DataFrame:
    rows = feature_rows(spark, d, matured)
    return ga.gate_table(rows, [F.col(c) for c in X_NAMES], [F.col(e) for e in EXPERTS], ["campaign", "cat1"])


def daily(predicted: DataFrame, names: list[str]) -> DataFrame:
    """(method, day, n, loss) of deployed predictions."""
    n, k = F.col("n"), F.col("clicks")
    wide = predicted.groupBy("day").agg(F.sum("n").cast("long").alias("n"), *[
        (F.sum(sc.tally_loss(n, k, F.col(f"p_{m}"))) / F.sum("n")).alias(m) for m in names])
    return wide.select("day", "n", F.inline(F.array(*[
        F.struct(F.lit(m).alias("method"), F.col(m).alias("loss")) for m in names])))


def _fit(spark, d, specs) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d)
    deployed = ga.train_gates(t, specs)
    return t, ga.predict_gates(t, specs, deployed, ["campaign", "cat1"])


def _mean_weights(predicted: DataFrame, name: str, experts: list[str]) -> DataFrame:
    n = F.sum("n")
    return predicted.groupBy("day").agg(*[
        F.round(F.sum(F.col("n") * F.col(f"w_{name}")[i]) / n, 6).alias(f"w_{e}") for i, e in enumerate(experts)])


@query("context_gate", "M11")
def context_gate(spark, d) -> DataFrame:
    """Per-row blend of the short and the long window, with the loss and the mean blend of each day."""
    _, out = _fit(spark, d, [PAIR_GATE])
    return daily(out, ["pair"]).select("method", "day", "n", r6("loss")).join(
        _mean_weights(out, "pair", [hi.SHORT, hi.LONG]), "day")


@query("multi_gate", "M12")
def multi_gate(spark, d) -> DataFrame:
    _, out = _fit(spark, d, [MULTI_GATE])
    return daily(out, ["multi"]).select("method", "day", "n", r6("loss")).join(_mean_weights(out, "multi", EXPERTS), "day")


@query("periodic_gate", "M13")
def periodic_gate(spark, d) -> DataFrame:
    _, out = _fit(spark, d, [PERIODIC_GATE])
    return daily(out, ["periodic"]).select("method", "day", "n", r6("loss")).join(
        _mean_weights(out, "periodic", EXPERTS), "day")


@query("stacked_gate", "M14")
def stacked_gate(spark, d) -> DataFrame:
    """Gates over finished methods: two of them (one logit) and three (softmax)."""
    base = ["pair", "multi", "stiff"]
    first, out = _fit(spark, d, [PAIR_GATE, MULTI_GATE, STIFF_GATE])
    preds = [f"p_{b}" for b in base]
    flat = out.select("day", "campaign", "cat1", "n", "clicks", *preds).withColumnsRenamed(dict(zip(preds, base)))
    losses = daily(flat.withColumnsRenamed({b: f"p_{b}" for b in base}), base).withColumnRenamed("method", "expert") \
        .withColumn("ord", F.lit(0))
    recent = fe.previous_day(losses, "expert", base)
    rows = fe.max_normalised(fe.multi_features(flat, recent, base, fx.last_day(spark, d)), ["campaign", "cat1"])
    diff = F.col("pair") - F.col("multi")
    rows = rows.withColumns({"abs_diff": F.abs(diff), "diff": diff, "grp01": F.lit(0), "early": F.lit(True)})
    names = [*base, "spread", "norm_t", *[f"recent_{b}" for b in base], "abs_diff", "diff", "ctx_campaign", "ctx_cat1"]

    def at(*cols):
        return tuple(names.index(c) for c in cols)

    two = ga.GateSpec("stack2", "pair", at("multi", "pair", "abs_diff", "diff", "norm_t", "recent_multi", "recent_pair",
                                           "ctx_campaign", "ctx_cat1"), (1, 0))
    three = ga.GateSpec("stack3", "multi", at(*base, "spread", "norm_t", *[f"recent_{b}" for b in base],
                                              "ctx_campaign", "ctx_cat1"), (0, 1, 2))
    t = ga.gate_table(rows, [F.col(c) for c in names], [F.col(b) for b in base], ["campaign", "cat1"])
    stacked = ga.predict_gates(t, [two, three], ga.train_gates(t, [two, three]), ["campaign", "cat1"])
    return daily(stacked, ["stack2", "stack3"]).select("method", "day", "n", r6("loss"))


def day_states(rows: DataFrame, last_day: int, matured: bool = False) -> dict[int, dict]:
    """Day-level inputs of the persistence logit, one row per calendar day."""
    if matured:
        return _states(available_inputs(rows, last_day), last_day)
    losses = fx.day_losses(hi.long_bank(rows, EXPERTS, ["day", "n", "clicks"]))
    out = fe.persistence_state(rows, losses, "expert", EXPERTS, hi.SHORT, hi.LONG, last_day)
    return _states(out, last_day)


def _states(out: DataFrame, last_day: int) -> dict[int, dict]:
    return {r["day"]: {"losses": [r[f"recent_{e}"] for e in EXPERTS], "disagreement": r["recent_disagreement"],
                       "ctr": r["recent_ctr"], "jump": r["loss_jump"], "norm_t": r["day"] / max(last_day, 1)} for r in out.collect()}


def _trace(spark, trace: list[dict]) -> DataFrame:
    rows = [(t["spec"], int(t["day"]), float(t["loss"]), float(t["beta"]), float(t["beta_std"]), float(t["beta_a"]),
             float(t["beta_b"]), *[float(w) for w in t["pi"]]) for t in trace]
    cols = "method string, day int, loss double, beta double, beta_std double, beta_a double, beta_b double, "
    out = literal_rows(spark, rows, cols + ", ".join(f"w_{e} double" for e in EXPERTS))
    return out.select("method", "day", *[r6(c) for c in out.columns[2:]])


def persist_variants() -> list[ga.PersistSpec]:
    full = dict(columns=MULTI + CONTEXT, experts=ALL)
    return [ga.PersistSpec("adaptive", **full), ga.PersistSpec("fixed_0.5", adaptive=False, fixed_beta=0.5, **full),
            ga.PersistSpec("no_context", columns=MULTI, experts=ALL), ga.PersistSpec("uniform_q", uniform_q=True, **full),
            ga.PersistSpec("time_only", state=(8,), **full)]


def _persist(spark, d, specs) -> list[dict]:
    t = table(spark, d)
    rows = t.select("day", "n", "clicks", *[F.col("p")[i].alias(e) for e, i in P_INDEX.items()])
    return ga.train_persistence(t, specs, day_states(rows, fx.last_day(spark, d)))


@query("adaptive_persistence", "M15")
def adaptive_persistence(spark, d) -> DataFrame:
    """Context gate with learned day-to-day persistence, and its ablations."""
    return _trace(spark, _persist(spark, d, persist_variants()))


def example_variants() -> list[ga.PersistSpec]:
    full = dict(columns=MULTI + CONTEXT, experts=ALL, per_example=True)
    return [ga.PersistSpec("per_example", **full), ga.PersistSpec("near_global", beta_var=100.0, **full),
            ga.PersistSpec("per_group", per_group=True, **full)]


@query("persistence_per_example", "M16")
def persistence_per_example(spark, d) -> DataFrame:
    return _trace(spark, _persist(spark, d, example_variants()))


@query("group_beta_gap", "W17")
def group_beta_gap(spark, d) -> DataFrame:
    """How far apart the persistence of the two groups is, per variant."""
    out = _trace(spark, _persist(spark, d, example_variants()))
    return out.groupBy("method").agg(r6(F.avg(F.abs(F.col("beta_a") - F.col("beta_b"))), "gap"),
                                     r6(F.avg("beta_std"), "spread"), F.count("*").alias("days"))


@query("persistence_matured", "M17")
def persistence_matured(spark, d) -> DataFrame:
    """The gate on matured labels only: midnight's tail joins the next day's update."""
    t = table(spark, d, matured=True)
    rows = t.select("day", "n", "clicks", "early", *[F.col("p")[i].alias(e) for e, i in P_INDEX.items()])
    spec = ga.PersistSpec("matured", columns=MULTI + CONTEXT, experts=ALL, matured=True)
    return _trace(spark, ga.train_persistence(t, [spec], day_states(rows, fx.last_day(spark, d), matured=True)))


@query("simplex_mix", "M18")
def simplex_mix(spark, d) -> DataFrame:
    """Constant expert weights of every origin, fitted on its three inner days, and the origin's loss."""
    wide = fx.wide_cells(spark, d)
    days = sp.day_axis(fx.cells(spark, d))
    origins = fx.eligible(days.select("day"))
    inner = sp.inner_days(days, origins, 3, fx.FIRST_ELIGIBLE).select("origin", F.col("inner_day").alias("day"))
    fitted = ga.fit_simplex(wide.join(F.broadcast(inner), "day"), EXPERTS, "origin")
    weights = literal_rows(spark, [(o, *map(float, w)) for o, w in sorted(fitted.items())],
                           "day int, " + ", ".join(f"w_{e} double" for e in EXPERTS))
    p = sum((F.col(f"w_{e}") * F.col(e) for e in EXPERTS), F.lit(0.0))
    shown = wide.join(F.broadcast(weights), "day")
    return shown.groupBy("day", *[f"w_{e}" for e in EXPERTS]).agg(
        F.sum("n").alias("n"), r6(F.sum(sc.tally_loss(F.col("n"), F.col("clicks"), p)) / F.sum("n"), "loss")).select(
        "day", "n", "loss", *[r6(f"w_{e}") for e in EXPERTS])


@query("smooth_sweep", "M20")
def smooth_sweep(spark, d) -> DataFrame:
    """Softmax gate over a grid of smoothness penalties: loss per period, best per period and overall."""
    grid = SMOOTH_GRID
    specs = [ga.GateSpec(f"smooth_{i}", "multi", MULTI + CONTEXT, ALL, smooth=g) for i, g in enumerate(grid)]
    _, out = _fit(spark, d, specs)
    return sweep_report(daily(out, [s.name for s in specs]), fx.first_test(spark, d))


@query("beta_sweep", "M20")
def beta_sweep(spark, d) -> DataFrame:
    """Fixed persistence over a grid, all replayed in the same jobs."""
    specs = [ga.PersistSpec(f"b{b:.2f}", columns=MULTI + CONTEXT, experts=ALL, adaptive=False, fixed_beta=b)
             for b in (i / 20 for i in range(21))]
    trace = _trace(spark, _persist(spark, d, specs))
    days = sp.day_axis(fx.cells(spark, d)).select("day", "n")
    return sweep_report(trace.select("method", "day", "loss").join(days, "day"), fx.first_test(spark, d))


def sweep_report(losses: DataFrame, first_test: int) -> DataFrame:
    """Per regime (dev, test): loss, excess over the regime's best; and the worst excess of each setting."""
    regime = F.when(F.col("day") >= first_test, "test").otherwise("dev").alias("regime")
    per = losses.groupBy("method", regime).agg(me.weighted_mean(F.col("loss"), F.col("n")).alias("loss"))
    best = per.groupBy("regime").agg(F.min("loss").alias("_best"),
                                     F.min_by("method", F.struct(F.round("loss", 10), "method")).alias("oracle"))
    excess = per.join(best, "regime").withColumn("excess", F.col("loss") - F.col("_best"))
    worst = excess.groupBy("method").agg(F.max("excess").alias("worst_excess"), F.avg("loss").alias("_mean"))
    top = worst.agg(F.min_by("method", F.struct(F.round("_mean", 10), "method")).alias("global_best"))
    return excess.join(worst, "method").crossJoin(top).select(
        "method", "regime", r6("loss"), r6("excess"), r6("worst_excess"), "oracle", "global_best")
