"""Structured Streaming versions of the within-day operators.

Each job reads the log in arrival order and gives the batch operator's result.
A log may be one file or a folder of any number of parts; ``replay`` lays it out
in event order, one slice per micro-batch. Rows are first summed up by block in
a windowed aggregation, which closes a block once the watermark has passed it;
what the keyed state then sees are a block's sums, not its rows. State is kept
in typed variables: a value for the parameters, a list for the labels that have
not matured. A day's state is cleared by a timer once the day is over. Rows
behind the watermark are dropped and counted (``Drained.late``).
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tidelog.functions import scoring as sc
from tidelog.functions import timeaxis as ta
from tidelog.operators import calibrate as ca
from tidelog.session import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A micro-batch has a fixed cost in every state partition: their number follows the rows, from a few upwards.
BATCHES = 4
BATCH_ROWS = 1_000_000


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _scratch(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/streams/{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet as a stream: one file, or all files below a folder, oldest first."""
    fs, at = _file_system(spark, path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if fs.getFileStatus(at).isDirectory():
        return reader.option("recursiveFileLookup", "true").parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def event_time(day: Column, sec: Column) -> Column:
    return F.timestamp_seconds(day.cast("long") * ta.SECONDS_PER_DAY + sec)


def replay(log: DataFrame, slices: int | None = None, files_per_trigger: int | None = None, lateness: str = "1 second",
           in_order: bool = True) -> DataFrame:
    """A finite log (row_id, day, sec, ...) as a stream with the event time ``at`` and its watermark.

    The log is written in slices by range of (day, sec, row_id); modification
    times follow the slices, so micro-batches come in event order however the
    log was partitioned. A micro-batch reads ``files_per_trigger`` slices: one
    where ``slices`` is given, else so many that there is a micro-batch for each
    BATCH_ROWS rows, BATCHES at least. A last file holds one row two days after
    the end: it moves the watermark past all real rows, and its own block never
    closes. With ``in_order`` false the slices arrive in reverse, as a late log would.
    """
    spark = log.sparkSession
    folder = f"{_scratch(spark)}/log"
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["day", "sec", "row_id"]
    log.repartitionByRange(n, *order).sortWithinPartitions(*order).write.parquet(folder)
    written = spark.read.schema(log.schema).parquet(folder)
    last = written.agg(F.max("day")).first()[0]
    fs, at = _file_system(spark, folder)
    files = sorted((f.getPath() for f in fs.listStatus(at) if f.getPath().getName().endswith(".parquet")), key=lambda p: p.getName())
    if not in_order:
        files.reverse()
    if last is not None:
        beat = written.where(F.col("day") == last).limit(1).withColumn("day", (F.col("day") + 2).cast(log.schema["day"].dataType))
        beat.coalesce(1).write.mode("append").parquet(folder)
        known = {p.getName() for p in files}
        files += [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().endswith(".parquet") and f.getPath().getName() not in known]
    if files_per_trigger is None:
        files_per_trigger = 1 if slices else max(1, len(files) // max(BATCHES, math.ceil(written.count() / BATCH_ROWS)))
    start = int(time.time() * 1000) - 1000 * (len(files) + 1)
    for i, path in enumerate(files):
        fs.setTimes(path, start + 1000 * i, -1)
    rows = file_stream(spark, folder, log.schema, files_per_trigger)
    return rows.withColumn("at", event_time(F.col("day"), F.col("sec"))).withWatermark("at", lateness)


@dataclass
class Drained:
    """What a drained stream reports: its micro-batches, the rows dropped behind the watermark, the state rows left,
    the partitions of a stateful operator."""

    batches: int = 0
    late: int = 0
    state_rows: int = 0
    partitions: int = 0


def drain(stream: DataFrame, mode: str, keys: list[str] | None = None, report: Drained | None = None) -> DataFrame:
    """Run a stream over all available input and return its result table; no input gives an empty one.

    Every micro-batch is written under its own id, so a retried batch overwrites
    itself; with ``keys`` the newest row of each key counts. State lies in at
    most one partition a core, since each of them is opened and committed in
    every micro-batch; the session's own setting stays as it was.
    """
    spark = stream.sparkSession
    base = _scratch(spark)
    schema = stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(int(before), spark.sparkContext.defaultParallelism))
    try:
        query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state")
                 .trigger(availableNow=True).foreachBatch(write).start())
    finally:
        spark.conf.set(setting, before)
    query.awaitTermination()
    if report is not None:
        progress = query.recentProgress
        report.batches = len(progress)
        report.late = sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
        report.state_rows = sum(op["numRowsTotal"] for op in progress[-1]["stateOperators"]) if progress else 0
        report.partitions = max((op["numStateStoreInstances"] for p in progress for op in p["stateOperators"]), default=0)
    fs, at = _file_system(spark, f"{base}/out")
    if not fs.exists(at):
        return spark.createDataFrame([], schema)
    table = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{base}/out")
    if keys is None:
        return table.drop("batch")
    newest = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return table.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r", "batch")


def _window(block_sec: int) -> Column:
    if ta.SECONDS_PER_DAY % block_sec:
        raise ValueError(f"blocks of {block_sec} seconds do not divide the day")
    return F.window("at", f"{block_sec} seconds")


def windowed_tokens(rows: DataFrame, block_sec: int) -> DataFrame:
    """Scalar token fields per tumbling block: rows (at, day, click, q) -> (day, block, ...)."""
    q, y = sc.clip(F.col("q"), sc.LOGIT_CLIP), F.col("click")
    blocks = rows.groupBy(_window(block_sec), "day")
    out = blocks.agg(F.count("*").alias("n"), F.avg(y).alias("mean_y"), F.avg(q).alias("mean_q"),
                     F.avg(y - q).alias("mean_r"), F.avg(sc.log_loss(y, q)).alias("mean_loss"))
    return out.select("day", ta.block_of(ta.sec_in_day(F.col("window.start")), block_sec).alias("block"),
                      "n", "mean_y", "mean_q", "mean_r", "mean_loss")


def windowed_day_metrics(rows: DataFrame) -> DataFrame:
    days = rows.groupBy(F.window("at", "1 day"), "day")
    y, p = F.col("click"), F.col("q")
    return days.agg(F.count("*").alias("n"), F.sum("click").alias("clicks"), F.avg(sc.log_loss(y, p)).alias("log_loss"),
                    F.avg((p - y) * (p - y)).alias("brier")).drop("window")


def _closed_blocks(rows: DataFrame, keys: list[str], block_sec: int, sums: list[Column], by: list[Column] | None = None) -> DataFrame:
    """A block's sums per key, once the watermark has closed it; ``closed`` carries the event time on."""
    block = ta.block_of(F.col("sec"), block_sec).alias("block")
    return rows.groupBy(_window(block_sec), *keys, block, *(by or [])).agg(*sums).withColumn(
        "closed", F.window_time("window")).drop("window")


def _keyed(rows: DataFrame, key: str, processor: StatefulProcessor, out_schema: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out_schema, outputMode="Append", timeMode="EventTime")


class _Blocks(StatefulProcessor):
    """What the block processors share: a value, a list of waiting sums, blocks handed on in order."""

    out: list[str]
    value: str
    waiting: str

    def init(self, handle) -> None:
        self.handle = handle
        self.params = handle.getValueState("params", self.value)
        self.queue = handle.getListState("queue", self.waiting)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [p for p in rows if len(p)]
        if not parts:
            return
        pdf = pd.concat(parts)
        state = tuple(self.params.get()) if self.params.exists() else None
        queue = [tuple(w) for w in self.queue.get()] if self.queue.exists() else []
        out: list[tuple] = []
        for (day, block), own in pdf.groupby(["day", "block"], sort=True):
            state, queue = self.block(key[0], int(day), int(block), own, state, queue, out)
        self.params.update(state)
        if queue:
            self.queue.put(queue)
        else:
            self.queue.clear()
        self.arm(key[0], timerValues)
        if out:
            yield pd.DataFrame(out, columns=self.out)

    def arm(self, key, timerValues) -> None:
        """Set the timer that ends this key's state, if it ends."""

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.params.clear()
        self.queue.clear()
        return iter(())

    def close(self) -> None:
        pass


class _OpsBlocks(_Blocks):
    out = ["day", "block", "a", "b", "step"]
    value = "a double, b double, step int, block int"
    waiting = "upd int, z double, n double, clicks double"

    def __init__(self, config: ca.OpsConfig):
        self.config = config

    def block(self, key, day, block, own, state, queue, out):
        a, b, step, at = state or (1.0, 0.0, 0, -1)
        c = self.config
        ripe = [w for w in queue if w[0] <= at] if at >= 0 else []
        if ripe:
            queue = [w for w in queue if w[0] > at]
            _, z, n, k = (np.array(x, dtype=float) for x in zip(*ripe, strict=True))
            step += 1
            eta = c.eta0 / math.sqrt(step) if c.decay_steps else c.eta0
            resid = n / (1.0 + np.exp(-np.clip(a * z + b, -30, 30))) - k
            db, da = resid.sum() / n.sum(), (resid * z).sum() / n.sum()
            b = float(np.clip(b - eta * db, -c.radius, c.radius))
            if c.platt:
                a = float(np.clip(a - eta * da, c.slope_lo, c.slope_hi))
        out.append((day, block, a, b, step))
        queue = queue + [(int(u), float(z), float(n), float(k)) for u, z, n, k in own[["upd", "z", "n", "clicks"]].itertuples(index=False)]
        return (a, b, step, block), queue

    def arm(self, key, timerValues) -> None:
        end = (int(key) + 1) * ta.SECONDS_PER_DAY * 1000
        self.handle.registerTimer(max(end, timerValues.getCurrentWatermarkInMs() + 1))


def ops_blocks(rows: DataFrame, config: ca.OpsConfig, block_sec: int, delay_sec: int) -> DataFrame:
    """Block calibration, one key per day: emits the state used in each block when the block closes.

    ``rows``: (at, row_id, day, sec, click, z). A day's state goes at its midnight.
    """
    upd = ta.update_block(F.col("sec"), block_sec, delay_sec).alias("upd")
    sums = [F.count("*").cast("double").alias("n"), F.sum("click").cast("double").alias("clicks")]
    cells = _closed_blocks(rows, ["day"], block_sec, sums, [upd, F.col("z")])
    # a second copy of the day stays among the values, the first is the key
    return _keyed(cells.withColumn("key_day", F.col("day")), "key_day", _OpsBlocks(config),
                  "day int, block int, a double, b double, step int")


WAITING_ROWS = np.dtype([("sec", "<i4"), ("row_id", "<i8"), ("click", "<i4"), ("z", "<f8")])
WAITING_LABELS = np.dtype([("ready", "<i4"), ("z", "<f8"), ("click", "<i4")])


class _OpsEvents(StatefulProcessor):
    """Rows wait until the watermark has passed them, labels until they are mature.

    What waits is kept as packed columns, one state entry for many rows.
    """

    def __init__(self, config: ca.OpsConfig, delay_sec: int):
        self.config, self.delay = config, delay_sec

    def init(self, handle) -> None:
        self.handle = handle
        self.params = handle.getValueState("params", "a double, b double, step int")
        self.rows = handle.getListState("rows", "packed binary")
        self.labels = handle.getListState("labels", "packed binary")

    @staticmethod
    def _unpacked(state, kind: np.dtype) -> np.ndarray:
        packed = [np.frombuffer(r[0], dtype=kind) for r in state.get()] if state.exists() else []
        return np.concatenate(packed) if packed else np.zeros(0, dtype=kind)

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            if len(pdf):
                packed = np.zeros(len(pdf), dtype=WAITING_ROWS)
                for name in WAITING_ROWS.names:
                    packed[name] = pdf[name].astype(WAITING_ROWS[name])  # a missing number is an error
                self.rows.appendValue((packed.tobytes(),))
                last = (int(key[0]) * ta.SECONDS_PER_DAY + int(pdf["sec"].max())) * 1000
                self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        c, passed = self.config, timerValues.getCurrentWatermarkInMs() / 1000 - int(key[0]) * ta.SECONDS_PER_DAY
        every = np.sort(self._unpacked(self.rows, WAITING_ROWS), order=["sec", "row_id", "click", "z"])
        ready = int(np.searchsorted(every["sec"], passed, side="right"))
        due, left = every[:ready], every[ready:]
        a, b, step = self.params.get() if self.params.exists() else (1.0, 0.0, 0)
        wait = np.concatenate([self._unpacked(self.labels, WAITING_LABELS), np.zeros(len(due), dtype=WAITING_LABELS)])
        for name, column in (("ready", due["sec"] + self.delay), ("z", due["z"]), ("click", due["click"])):
            wait[name][len(wait) - len(due):] = column
        labels, clicks, head, known = wait["z"].tolist(), wait["click"].tolist(), 0, len(wait) - len(due)
        # how many labels are mature when a row comes; a row's own and later ones are not
        mature = np.minimum(np.searchsorted(wait["ready"], due["sec"], side="right"), known + np.arange(len(due))).tolist()
        out = []
        for z, until in zip(due["z"].tolist(), mature, strict=True):
            while head < until:
                wz, wy = labels[head], clicks[head]
                head += 1
                step += 1
                eta = c.eta0 / math.sqrt(step) if c.decay_steps else c.eta0
                resid = 1.0 / (1.0 + math.exp(-min(30.0, max(-30.0, a * wz + b)))) - wy
                b = min(c.radius, max(-c.radius, b - eta * resid))
                if c.platt:
                    a = min(c.slope_hi, max(c.slope_lo, a - eta * resid * wz))
            out.append(1.0 / (1.0 + math.exp(-min(30.0, max(-30.0, a * z + b)))))
        over = passed >= ta.SECONDS_PER_DAY
        for state, rest in ((self.rows, left), (self.labels, wait[head:])):
            if over or not len(rest):
                state.clear()
            else:
                state.put([(rest.tobytes(),)])
        if over:
            self.params.clear()
        else:
            self.params.update((a, b, step))
            if len(due) and not len(left):  # nothing waits for another timer: the day's end is the next
                self.handle.registerTimer(max((int(key[0]) + 1) * ta.SECONDS_PER_DAY * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        if out:
            yield pd.DataFrame({"row_id": due["row_id"], "day": int(key[0]), "p": out})

    def close(self) -> None:
        pass


def ops_events(rows: DataFrame, config: ca.OpsConfig, delay_sec: int) -> DataFrame:
    """One update per matured label: emits every row's prediction. ``rows``: (at, row_id, day, sec, click, z).

    Rows are taken in event order once the watermark has passed them, whatever order they came in.
    """
    return _keyed(rows.select("at", "day", "sec", "row_id", "click", "z"), "day", _OpsEvents(config, delay_sec),
                  "row_id long, day int, p double")


class _OnsBlocks(_Blocks):
    out = ["stream", "day", "block", "a", "b", "step"]
    value = "a double, b double, a00 double, a01 double, a11 double, step int, day int, block int"
    waiting = "ready long, z double, n double, clicks double"

    def __init__(self, config: ca.OnsConfig, block_sec: int, delay_sec: int):
        self.config, self.block_sec, self.delay = config, block_sec, delay_sec

    def block(self, key, day, block, own, state, queue, out):
        c = self.config
        fresh = (1.0, 0.0, c.ridge, 0.0, c.ridge, 0)
        a, b, a00, a01, a11, step = state[:6] if state else fresh
        midnight = day * ta.SECONDS_PER_DAY
        start = midnight + block * self.block_sec
        reset = c.reset_daily and state is not None and state[6] < day
        ripe = [w for w in queue if w[0] <= start]
        for ready in sorted({w[0] for w in ripe}):
            if reset and ready > midnight:
                a, b, a00, a01, a11, step = fresh
                reset = False
            z, n, k = (np.array(x) for x in list(zip(*[w for w in ripe if w[0] == ready], strict=True))[1:])
            theta = np.array([a, b])
            sums = ca.ons_sums(theta, z, n, k, c)
            theta, curve, _ = ca.ons_step(theta, np.array([[a00, a01], [a01, a11]]), sums, c, self.block_sec)
            (a, b), (a00, a01, a11), step = map(float, theta), map(float, (curve[0, 0], curve[0, 1], curve[1, 1])), step + 1
        if reset:
            a, b, a00, a01, a11, step = fresh
        out.append((str(key), day, block, a, b, step))
        queue = [w for w in queue if w[0] > start] + [
            (start + self.block_sec + self.delay, float(z), float(n), float(k)) for z, n, k in own[["z", "n", "clicks"]].itertuples(index=False)]
        return (a, b, a00, a01, a11, step, day, block), queue


def ons_blocks(rows: DataFrame, config: ca.OnsConfig, block_sec: int, delay_sec: int) -> DataFrame:
    """Newton calibration carried across days, one key per stream: emits the state used in each block.

    ``rows``: (at, stream, row_id, day, sec, click, z). The keyed state reads one
    row for each block and distinct z; labels wait as such rows until mature.
    """
    sums = [F.count("*").cast("double").alias("n"), F.sum("click").cast("double").alias("clicks")]
    cells = _closed_blocks(rows, ["stream", "day"], block_sec, sums, [F.col("z")])
    return _keyed(cells, "stream", _OnsBlocks(config, block_sec, delay_sec),
                  "stream string, day int, block int, a double, b double, step int")


class _ShareBlocks(_Blocks):
    out = ["stream", "day", "block", "w0", "w1", "w2", "n_updates"]
    value = "w0 double, w1 double, w2 double, n int"
    waiting = "ready long, n double, l0 double, l1 double, l2 double"

    def __init__(self, config: ca.ShareConfig, block_sec: int, delay_sec: int):
        self.config, self.block_sec, self.delay = config, block_sec, delay_sec

    def block(self, key, day, block, own, state, queue, out):
        prior = np.array(self.config.prior())
        rate = sc.share_rate(self.block_sec, self.config.half_life_h * 3600.0)
        *w, n = state or (*prior.tolist(), 0)
        start = day * ta.SECONDS_PER_DAY + block * self.block_sec
        for _, rows, *losses in sorted(q for q in queue if q[0] <= start):
            w = ca.share_step(np.array(w), np.array(losses) / rows, prior, self.config.eta, rate).tolist()
            n += 1
        out.append((str(key), day, block, *w, n))
        sums = own[["n", "l0", "l1", "l2"]].sum()
        queue = [q for q in queue if q[0] > start] + [(start + self.block_sec + self.delay, *map(float, sums))]
        return (*w, n), queue


def share_blocks(rows: DataFrame, config: ca.ShareConfig, block_sec: int, delay_sec: int) -> DataFrame:
    """Delayed fixed share over three predictions, one key per stream: emits the weights used in each block.

    ``rows``: (at, stream, row_id, day, sec, click, p0, p1, p2). The keyed state reads one row a block.
    """
    sums = [F.count("*").cast("double").alias("n"), *[
        F.sum(sc.log_loss(F.col("click"), F.col(f"p{i}"))).alias(f"l{i}") for i in range(3)]]
    return _keyed(_closed_blocks(rows, ["stream", "day"], block_sec, sums), "stream", _ShareBlocks(config, block_sec, delay_sec),
                  "stream string, day int, block int, w0 double, w1 double, w2 double, n_updates int")
