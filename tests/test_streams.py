"""Streams over one file, over folders of parts, and over nothing."""

import os
import shutil
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelog.operators import calibrate as ca
from tidelog.plans import stream_queries as sq
from tidelog.plans.catalog import QUERIES
from tidelog.streaming import jobs

NAMES = ["stream_scan", "stream_block_tokens", "stream_ops", "ops_impression", "stream_ons", "stream_fixed_share", "stream_day_metrics"]


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def folders(spark, sf, tmp_path_factory):
    """The events as one file, as 40 parts of mixed rows, and as nested folders."""
    base = tmp_path_factory.mktemp("logs")
    events = spark.read.parquet(f"{sf}/events.parquet")
    one, many, nested = (str(base / n) for n in ("one", "many", "nested"))
    os.makedirs(one)
    shutil.copy(f"{sf}/events.parquet", f"{one}/events.parquet")
    events.repartition(40, F.xxhash64("event_id")).write.parquet(f"{many}/events.parquet")
    for i in range(3):
        events.where(F.col("event_id") % 3 == i).coalesce(2).write.parquet(f"{nested}/events.parquet/{i}")
    return {"one": one, "many": many, "nested": nested}


@pytest.mark.parametrize("name", NAMES)
def test_a_folder_of_parts_gives_what_one_file_gives(spark, folders, name):
    want = rows(QUERIES[name](spark, folders["one"]))
    assert want and rows(QUERIES[name](spark, folders["many"])) == want


def test_nested_folders_are_read(spark, folders):
    schema = spark.read.parquet(f"{folders['one']}/events.parquet").schema
    raw = jobs.file_stream(spark, f"{folders['nested']}/events.parquet", schema, files_per_trigger=1)
    report = jobs.Drained()
    got = jobs.drain(raw.select("event_id"), "append", report=report)
    want = spark.read.parquet(f"{folders['one']}/events.parquet").select("event_id")
    assert rows(got) == rows(want) and report.batches >= 3


def test_an_empty_log_gives_an_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_scan", "stream_ops", "stream_day_metrics"):
        out = QUERIES[name](spark, str(tmp_path))
        assert out.collect() == [] and len(out.columns) > 3


def test_micro_batches_follow_the_clock(spark, sf):
    """Every slice of a replay starts where the one before ended."""
    seen = []
    stream = sq.impressions(spark, sf)
    query = stream.writeStream.foreachBatch(lambda b, i: seen.append(b.agg(F.min("at"), F.max("at")).first())).option(
        "checkpointLocation", jobs._scratch(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    spans = [s for s in seen if s[0] is not None]
    assert len(spans) >= 4 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("job", ["stream_block_tokens", "stream_ops", "stream_ons", "stream_fixed_share", "stream_day_metrics"])
def test_micro_batches_and_state_do_not_follow_the_shuffle_partitions(spark, sf, monkeypatch, job):
    """Many shuffle partitions make neither a micro-batch each nor a state partition each, and no other result."""
    reports, drain = [], jobs.drain

    def watched(stream, mode, keys=None):
        reports.append(jobs.Drained())
        return drain(stream, mode, keys, reports[-1])

    want = rows(QUERIES[job](spark, sf))
    monkeypatch.setattr(jobs, "drain", watched)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        got = rows(QUERIES[job](spark, sf))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "20"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want and len(reports) == 1
    assert jobs.BATCHES <= reports[0].batches <= jobs.BATCHES + 3
    stores = 2 * spark.sparkContext.defaultParallelism if job in ("stream_ops", "stream_ons", "stream_fixed_share") else 0
    assert reports[0].late == 0 and reports[0].partitions <= max(stores, spark.sparkContext.defaultParallelism)


class Kept:
    """A state variable held in memory: what it holds and how often it was written."""

    def __init__(self):
        self.held, self.writes = [], 0

    def exists(self):
        return bool(self.held)

    def get(self):
        return iter(self.held)

    def put(self, held):
        self.held, self.writes = list(held), self.writes + 1

    def appendValue(self, value):
        self.held, self.writes = [*self.held, value], self.writes + 1

    def appendList(self, values):
        for value in values:
            self.appendValue(value)

    def update(self, value):
        self.put(value)

    def clear(self):
        self.held = []


class Watch:
    def __init__(self, sec):
        self.sec = sec

    def getCurrentWatermarkInMs(self):
        return self.sec * 1000


def test_waiting_rows_are_one_entry_a_batch():
    """ops_impression: 3,000 rows in three batches make three state entries and the predictions of one update a label."""
    rng, day, delay = np.random.default_rng(4), 2, 500
    c = ca.OpsConfig("e", eta0=0.05, platt=True)
    log = pd.DataFrame({"sec": np.sort(rng.integers(0, 80_000, 3000)), "row_id": np.arange(3000) + (1 << 60),
                        "click": rng.integers(0, 2, 3000), "z": rng.normal(size=3000)})
    states = {}
    job = jobs._OpsEvents(c, delay)
    handle = SimpleNamespace(registerTimer=lambda at: None, getValueState=lambda name, kind: states.setdefault(name, Kept()),
                             getListState=lambda name, kind: states.setdefault(name, Kept()))
    job.init(handle)
    out = []
    for i, part in enumerate(np.array_split(np.arange(3000), 3)):
        own = log.iloc[part].sample(frac=1.0, random_state=i)
        assert list(job.handleInputRows((day,), iter([own]), Watch(0))) == []
        if i == 1:  # the watermark stands amid the second part
            out += job.handleExpiredTimer((day,), Watch(day * 86_400 + int(own["sec"].median())), None)
    assert states["rows"].writes <= 4
    out += job.handleExpiredTimer((day,), Watch((day + 1) * 86_400), None)
    got = pd.concat(out).set_index("row_id")["p"]
    a, b, step, head = 1.0, 0.0, 0, 0
    for i, r in enumerate(log.itertuples()):
        while head < i and log["sec"][head] + delay <= r.sec:
            z, step = log["z"][head], step + 1
            e = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - log["click"][head]
            eta = c.eta0 / np.sqrt(step) if c.decay_steps else c.eta0
            b, a, head = np.clip(b - eta * e, -c.radius, c.radius), np.clip(a - eta * e * z, c.slope_lo, c.slope_hi), head + 1
        assert abs(got[r.row_id] - 1 / (1 + np.exp(-np.clip(a * r.z + b, -30, 30)))) < 1e-9
    assert len(got) == 3000 and not any(s.held for s in states.values())
