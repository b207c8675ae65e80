"""Embedding near-duplicates by an epsilon grid order join.

A cosine of at least ``threshold`` is a distance of at most epsilon between unit
vectors. Distinct vectors are put into grid order: by their cells of width
epsilon, then of an eighth of it, on the leading principal dimensions. The
sequence is cut into tiles; tiles form a tree of intervals. Pairs of intervals
are joined from the top: provably distant ones (by their boxes on the leading
dimensions, or by their balls in all dimensions) are skipped, provably close
ones are counted whole, the others are split. Pairs of tiles left over meet in a
task, which goes on with the same recursion down to leaves and compares those by
matrix products. Bounds only save work: every pair that may link is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import ready, stash
from tidelog.llm.components import connected_components

TILE = 8192
PACK = 16
LEAF = 512
FAN = 16
DIMS = 8
FIT_VALUES = 1 << 21
SLACK = 1e-9


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row by a power of two, its largest component in [0.5, 1): the cosine is the same, no square overflows."""
    _, power = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -power[:, None])


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def dense(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of ``dims`` doubles, shorter lists padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), dims))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Interval:
    """Rows lo to hi of a tile with the ball around them and, on the leading dimensions, their box."""

    def __init__(self, unit: np.ndarray, led: np.ndarray, weight: np.ndarray, lo: int, hi: int, leaf: int) -> None:
        own = unit[lo:hi]
        self.lo, self.hi = lo, hi
        self.center = own.mean(axis=0)
        self.radius = math.sqrt(((own - self.center) ** 2).sum(axis=1).max())
        self.low, self.high = led[lo:hi].min(axis=0), led[lo:hi].max(axis=0)
        self.weight = int(weight[lo:hi].sum())
        mid = (lo + hi) // 2
        self.parts = [] if hi - lo <= leaf else [Interval(unit, led, weight, *ends, leaf) for ends in ((lo, mid), (mid, hi))]

    def far(self, other: Interval, eps: float) -> bool:
        gap = np.maximum(0, np.maximum(self.low - other.high, other.low - self.high))
        apart = math.dist(self.center, other.center)
        return math.sqrt((gap * gap).sum()) > eps + SLACK or apart - self.radius - other.radius > eps + SLACK

    def near(self, other: Interval, eps: float) -> bool:
        return math.dist(self.center, other.center) + self.radius + other.radius < eps - SLACK


class Tile:
    def __init__(self, cls: np.ndarray, weight: np.ndarray, vectors: np.ndarray, basis: np.ndarray, leaf: int) -> None:
        self.cls, self.weight, self.vectors = cls, weight, scaled(vectors)
        self.unit = units(self.vectors)
        self.root = Interval(self.unit, self.unit @ basis, weight, 0, len(cls), leaf)
        self.found = np.zeros(len(cls), dtype=np.int64)


def _matches(x: Tile, y: Tile, i: Interval, j: Interval, threshold: float) -> np.ndarray:
    cos = x.unit[i.lo:i.hi] @ y.unit[j.lo:j.hi].T
    hit = cos >= threshold
    for a, b in np.argwhere(np.abs(cos - threshold) < SLACK).tolist():  # by the definition where rounding decides
        u, v = x.vectors[i.lo + a], y.vectors[j.lo + b]
        hit[a, b] = float(u @ v) / (math.sqrt(float(u @ u)) * math.sqrt(float(v @ v))) >= threshold
    return hit


def _spanning(hit: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that connect what the matches connect."""
    rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    if not len(rows):
        return []
    own = hit[np.ix_(rows, cols)]
    # the first column of a row, and for a column the first row; then the least label spreads until nothing changes
    label, none = np.arange(len(rows)), len(rows)
    while True:
        of_col = np.where(own, label[:, None], none).min(axis=0)
        fresh = np.where(own, of_col[None, :], none).min(axis=1)
        if (fresh == label).all():
            break
        label = fresh
    at = np.zeros(len(rows), dtype=np.int64)
    at[label] = own[label].argmax(axis=1)  # a component's first row and one column of it
    anchor = at[label]
    return [(int(rows[r]), int(cols[anchor[r]])) for r in range(len(rows))] + [
        (int(rows[of_col[c]]), int(cols[c])) for c in range(len(cols))]


def join_tiles(x: Tile, y: Tile, threshold: float) -> list[tuple[int, int]]:
    """Add up linked weights in both tiles' ``found`` (own rows left out); return links (class, class) that span them."""
    eps, same, links = math.sqrt(2 - 2 * threshold), x is y, []
    todo = [(x.root, y.root)]
    while todo:
        i, j = todo.pop()
        if i.far(j, eps):
            continue
        if i.near(j, eps):
            x.found[i.lo:i.hi] += j.weight
            if not (same and i is j):
                y.found[j.lo:j.hi] += i.weight
            a, b = x.cls[i.lo:i.hi].tolist(), y.cls[j.lo:j.hi].tolist()
            links += [(c, b[0]) for c in a] + [(a[0], c) for c in b]
        elif same and i is j and i.parts:
            todo += [(i.parts[0], i.parts[0]), (i.parts[0], i.parts[1]), (i.parts[1], i.parts[1])]
        elif i.parts or j.parts:
            if i.parts and (not j.parts or i.hi - i.lo >= j.hi - j.lo):
                todo += [(part, j) for part in i.parts]
            else:
                todo += [(i, part) for part in j.parts]
        else:
            hit = _matches(x, y, i, j, threshold)
            if same and i is j:
                np.fill_diagonal(hit, True)
            x.found[i.lo:i.hi] += hit @ y.weight[j.lo:j.hi]
            if not (same and i is j):
                y.found[j.lo:j.hi] += x.weight[i.lo:i.hi] @ hit
            links += [(int(x.cls[i.lo + a]), int(y.cls[j.lo + b])) for a, b in _spanning(hit)]
    if same:
        x.found -= x.weight
    return [(a, b) for a, b in links if a != b]


def forest(links: list[tuple[int, int]]) -> dict[int, int]:
    """Class -> the least class its links reach, for all classes that have links."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (up := parent.setdefault(i, i)) != i:
            parent[i] = parent[up]
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in list(parent)}


def leading(vectors: DataFrame, dims: int, k: int) -> np.ndarray:
    """(dims, k): the leading principal directions of a bounded sample of unit vectors. They steer the order, never a result."""
    most = max(1, FIT_VALUES // dims)
    rows = vectors.select("v").orderBy(F.xxhash64("v")).limit(most).collect()
    found = np.zeros((len(rows), dims))
    for at, r in enumerate(rows):
        found[at, :len(r["v"])] = r["v"]
    unit = units(scaled(found))
    _, axes = np.linalg.eigh(np.cov(unit.T).reshape(dims, dims) if len(rows) > 1 else np.eye(dims))
    return np.ascontiguousarray(axes[:, ::-1][:, :k])


def ordered_tiles(vectors: DataFrame, basis: np.ndarray, eps: float, tile: int) -> DataFrame:
    """(cls, w, v) -> rows in grid order, written: packs of vectors (center null), and one row a tile with its bounds."""
    dims, k = basis.shape

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = dense(batch.column(2), dims)
            led = units(scaled(found)) @ basis
            cells = np.floor(np.concatenate([led / eps, led * 8 / eps], axis=1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(cells), pa.list_(pa.int32())), pa.array(
                [row.tobytes() for row in found], pa.binary())], ["cls", "w", "cells", "data"])

    names = ["tile", "at", "n", "weight", "first", "cls", "w", "data", "center", "radius", "low", "high"]
    double, some = pa.float64(), pa.list_(pa.float64())
    kinds = [pa.int64()] * 5 + [pa.binary()] * 3 + [some, double, some, some]

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        number = 0

        def told() -> pa.RecordBatch:
            cls, w = (np.array([r[c] for r in held], dtype=np.int64) for c in (0, 1))
            unit = units(scaled(np.frombuffer(b"".join(r[2] for r in held)).reshape(len(held), dims)))
            whole = Interval(unit, unit @ basis, w, 0, len(held), len(held))
            out = [(number, at // PACK, len(held[at:at + PACK]), None, None, cls[at:at + PACK].tobytes(), w[at:at + PACK].tobytes(),
                    b"".join(r[2] for r in held[at:at + PACK]), None, None, None, None) for at in range(0, len(held), PACK)]
            out.append((number, None, len(held), whole.weight, int(cls[0]), None, None, None, whole.center.tolist(), whole.radius,
                        whole.low.tolist(), whole.high.tolist()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == tile:
                    yield told()
                    held, number = [], number + 1
        if held:
            yield told()

    count, spark = vectors.count(), vectors.sparkSession
    slices = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, -(-count // tile)))
    keyed = stash(ready(vectors).select("cls", "w", "v").mapInArrow(celled, "cls long, w long, cells array<int>, data binary"))
    order = ["cells", "cls"]
    rows = keyed.repartitionByRange(slices, *order).sortWithinPartitions(*order).select("cls", "w", "data").mapInArrow(
        tiled, "tile long, at long, n long, weight long, first long, cls binary, w binary, data binary, "
        "center array<double>, radius double, low array<double>, high array<double>").withColumn("slice", F.spark_partition_id())
    rows = stash(rows)
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row for each slice
    starts = rows.groupBy("slice").agg(F.max("tile").alias("last")).select(
        "slice", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(starts), "slice").withColumn("tile", F.col("tile") + F.col("before")).drop("slice", "before")


def _gap(i: str, j: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(i, j, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))


def _box_gap() -> Column:
    """Distance of the boxes of sides i and j."""
    over = F.zip_with("low_i", "high_j", lambda x, y: F.greatest(F.lit(0.0), x - y))
    under = F.zip_with("low_j", "high_i", lambda x, y: F.greatest(F.lit(0.0), x - y))
    return F.sqrt(F.aggregate(F.zip_with(over, under, lambda x, y: F.greatest(x, y)), F.lit(0.0), lambda t, x: t + x * x))


def _raised(nodes: DataFrame, fan: int) -> DataFrame:
    """The next level of the interval tree: every ``fan`` neighbours in one, their ball around the mean of the centers."""
    def merge(part: pd.DataFrame) -> pd.DataFrame:
        centers = np.array(part["center"].tolist())
        center = centers.mean(axis=0)
        return pd.DataFrame({
            "idx": [int(part["up"].iloc[0])], "n": [int(part["n"].sum())], "weight": [int(part["weight"].sum())],
            "first": [int(part.loc[part["idx"].idxmin(), "first"])], "center": [center.tolist()],
            "radius": [float((np.sqrt(((centers - center) ** 2).sum(axis=1)) + part["radius"]).max())],
            "low": [np.array(part["low"].tolist()).min(axis=0).tolist()], "high": [np.array(part["high"].tolist()).max(axis=0).tolist()]})

    return nodes.withColumn("up", F.floor(F.col("idx") / fan)).groupBy("up").applyInPandas(merge, nodes.schema)


def tile_pairs(tiles: DataFrame, eps: float, fan: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Tiles with bounds -> (pairs i <= j to compare, levels of the tree, pairs of each level that link throughout)."""
    levels = [tiles]
    while levels[-1].count() > fan:
        levels.append(stash(_raised(levels[-1], fan)))
    near: list[DataFrame] = [tiles.sparkSession.createDataFrame([], "i long, j long")] * len(levels)
    last = levels[-1].count() - 1
    pairs = levels[-1].select(F.col("idx").alias("i"), F.explode(F.sequence("idx", F.lit(last).cast("long"))).alias("j")) if last >= 0 else None
    for level in range(len(levels) - 1, -1, -1):
        if pairs is None:
            break
        i, j = (levels[level].select(F.col("idx").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("center", "radius", "low", "high")])
                for s in "ij")
        met = pairs.join(i, "i").join(j, "j").withColumn("apart", _gap("center_i", "center_j")).where(
            (_box_gap() <= eps + SLACK) & (F.col("apart") - F.col("radius_i") - F.col("radius_j") <= eps + SLACK))
        judged = stash(met.select("i", "j", (F.col("apart") + F.col("radius_i") + F.col("radius_j") < eps - SLACK).alias("close")))
        near[level] = judged.where("close").select("i", "j")
        pairs = judged.where("not close").select("i", "j")
        if level:
            parts = [F.explode(F.sequence(F.col(s) * fan, F.col(s) * fan + (fan - 1))).alias(f"{s}_") for s in "ij"]
            pairs = pairs.select("j", parts[0]).select("i_", parts[1]).where("i_ <= j_").select(F.col("i_").alias("i"), F.col("j_").alias("j"))
    return pairs, levels, near


def compared(packs: DataFrame, pairs: DataFrame, basis: np.ndarray, threshold: float, leaf: int) -> DataFrame:
    """(cls, root, links): for each pair of tiles, the classes that link there, the least class reached, the weight linked."""
    dims = basis.shape[0]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def tile_of(rows: list[tuple]) -> Tile:
            return Tile(*(np.frombuffer(b"".join(r[c] for r in rows), dtype=np.int64) for c in (3, 4)),
                        np.frombuffer(b"".join(r[5] for r in rows)).reshape(-1, dims), basis, leaf)

        def told() -> pa.RecordBatch:
            x = tile_of([r for r in held if r[2] == 0])
            y = x if held[0][0] == held[0][1] else tile_of([r for r in held if r[2] == 1])
            roots = forest(join_tiles(x, y, threshold))
            cls, found = (np.concatenate([getattr(t, name) for t in ({id(x): x, id(y): y}).values()]) for name in ("cls", "found"))
            at = np.flatnonzero(found)
            return pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array([roots[c] for c in cls[at].tolist()], pa.int64()), pa.array(found[at])],
                                              ["cls", "root", "links"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:2] != row[:2]:
                    yield told()
                    held = []
                held.append(row)
        if held:
            yield told()

    sides = packs.select("tile", "at", "cls", "w", "data")
    left = sides.join(pairs.withColumn("tile", F.col("i")), "tile").withColumn("side", F.lit(0))
    right = sides.join(pairs.where("i < j").withColumn("tile", F.col("j")), "tile").withColumn("side", F.lit(1))
    slices = int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = left.unionByName(right).select("i", "j", "side", "cls", "w", "data", "at")
    return both.repartition(slices, "i", "j").sortWithinPartitions("i", "j", "side", "at").drop("at").mapInArrow(
        joined, "cls long, root long, links long")


def _members(packs: DataFrame) -> DataFrame:
    """(tile, cls, w): one row a class."""
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(b, dtype=np.int64) for b in batch.column(1).to_pylist()]
            if parts:
                tiles = np.repeat(batch.column(0).to_numpy(), [len(p) for p in parts])
                w = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tiles), pa.array(np.concatenate(parts)), pa.array(w)], ["tile", "cls", "w"])

    return packs.select("tile", "cls", "w").mapInArrow(opened, "tile long, cls long, w long")


def close_intervals(packs: DataFrame, levels: list[DataFrame], near: list[DataFrame], fan: int) -> tuple[DataFrame, DataFrame]:
    """What whole intervals that link throughout give their classes: (cls, links) and links (a, b) that span them."""
    spark, adds, ties = packs.sparkSession, [], []
    for level, pairs in enumerate(near):
        if not pairs.limit(1).count():
            continue
        nodes = levels[level].select("idx", "weight", "first")
        ways = pairs.select("i", "j").union(pairs.where("i < j").select("j", "i"))
        named = ways.join(nodes.select(F.col("idx").alias("i"), F.col("first").alias("first_i")), "i").join(
            nodes.withColumnRenamed("idx", "j"), "j")
        ties.append(named.select(F.col("first_i").alias("a"), F.col("first").alias("b")))
        sums = named.groupBy("i", "first_i").agg(F.sum("weight").alias("links"), F.count_if(F.col("i") == F.col("j")).alias("own"))
        width = fan ** level
        adds.append(sums.select(F.explode(F.sequence(F.col("i") * width, F.col("i") * width + (width - 1))).alias("tile"), "first_i", "links", "own"))
    none = spark.createDataFrame([], "cls long, links long")
    if not adds:
        return none, spark.createDataFrame([], "a long, b long")
    every = adds[0]
    for more in adds[1:]:
        every = every.union(more)
    members = stash(every).join(_members(packs), "tile")
    rows = members.groupBy("cls", "w").agg(F.sum("links").alias("links"), F.sum("own").alias("own")).select(
        "cls", (F.col("links") - F.col("own") * F.col("w")).alias("links"))
    spans = members.select(F.col("cls").alias("a"), F.col("first_i").alias("b"))
    for more in ties:
        spans = spans.union(more)
    return rows, spans


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding",
                 tile: int = TILE, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``; links at a cosine of ``threshold`` or more.

    Vectors that are null, empty or zero, or hold null or non-finite components,
    link with nothing: no links, their own id, kept. Shorter vectors count as
    padded with zeros. Equal vectors link whatever their ids; rows that share an
    id are rows of their own and count each other. ``component_id`` is the least
    id reachable; null ids are no least id unless all of a component are null,
    and are not kept. Equality of vectors is found by two 64-bit hashes. An
    empty table gives an empty table. Other columns are not read.
    """
    v = F.col(vector_col)
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = stash(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), F.when(sound, v).alias("v")))
    keys = [F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(s), "v")).alias(f"k{s}") for s in (1, 2)]
    marked = stash(rows.select("row", "vec_id", *keys))
    classes = stash(marked.where("k1 is not null").groupBy("k1", "k2").agg(
        F.min("row").alias("cls"), F.count("*").alias("w"), F.min("vec_id").alias("least")))
    firsts = stash(classes.select("cls", "w").join(rows.select(F.col("row").alias("cls"), "v"), "cls"))
    dims = firsts.agg(F.max(F.size("v"))).first()[0] or 1
    eps = math.sqrt(2 - 2 * threshold)
    basis = leading(firsts, dims, min(DIMS, dims))
    sequence = ordered_tiles(firsts, basis, eps, tile)
    packs = sequence.where("center is null")
    tiles = stash(sequence.where("center is not null").select(
        F.col("tile").alias("idx"), "n", "weight", "first", "center", "radius", "low", "high"))
    pairs, levels, near = tile_pairs(tiles, eps, fan)
    whole, spans = close_intervals(packs, levels, near, fan)
    if pairs is not None:
        found = stash(compared(packs, pairs, basis, threshold, leaf))
        whole = whole.union(found.select("cls", "links"))
        spans = spans.union(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    sums = whole.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = stash(connected_components(spans))
    rooted = stash(classes.join(sums, "cls", "left").join(roots, classes["cls"] == roots["node"], "left").select(
        "k1", "k2", "w", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    known = rooted.join(least, "root").select("k1", "k2", (F.col("links") + F.col("w") - 1).alias("links"), "component")
    linked = marked.where("k1 is not null").join(known, ["k1", "k2"]).select("vec_id", "links", "component")
    alone = marked.where("k1 is null").select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    return linked.union(alone).select(
        "vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))


def op13(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors)


SQL = """
with recursive sound as (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from sound a join sound b on a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.9),
reach(vec_id, other) as (
  select vec_id, vec_id from embeddings union select r.vec_id, l.b from reach r join links l on l.a = r.other),
least as (select vec_id, min(other) as component_id from reach group by vec_id),
counted as (select a as vec_id, count(*) as n_links from links group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from least left join counted using (vec_id)
"""
