"""SimHash near-duplicates: distinct fingerprints, compared bit-sliced inside exact candidate buckets.

Texts become 64-bit fingerprints; equal ones collapse into one row. Two
fingerprints within two bits agree on at least two of four 16-bit blocks, so
each goes to six buckets (one for each pair of blocks) and every link lies in a
bucket. A bucket beyond ``bucket_rows`` is dealt out again: the differing bits
touch at most two of the eight nibbles still free, so one of 28 further masks
leaves both fingerprints equal; those buckets hold at most 256 rows. Within a
bucket, bit planes are stored vertically and compared with carry-save counters.
A bucket gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import ready, stash
from tidelog.llm.components import connected_components

BLOCK_MASKS = [sum(0xFFFF << (16 * b) for b in pair) for pair in combinations(range(4), 2)]
BUCKET_ROWS = 4096
LANES = 1 << 16


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def finer_masks(mask: int) -> list[int]:
    """Masks that keep ``mask`` and all but two of the nibbles outside it."""
    free = [0xF << (4 * n) for n in range(16) if not mask >> (4 * n) & 1]
    return [(1 << 64) - 1 - x - y for x, y in combinations(free, 2)]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of word shingles, unsigned; zero for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, last, LANES):
        stop = min(last, at + LANES)
        hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(
            starts[at:stop].tolist(), ends[at:stop].tolist(), strict=True)), dtype="<u8", count=stop - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > last, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``; a null text counts as empty."""
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t, shingle)) for t in texts], dtype="int64")

    return ready(docs).select(F.col(id_col).alias("doc_id"), simhash(F.col(text_col)).alias("fp"))


def _plane(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _lanes(plane: int, n: int) -> np.ndarray:
    raw = np.frombuffer(plane.to_bytes((n + 7) // 8, "little"), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")[:n])


def within_two(planes: list[int], shift: int, wanted: int) -> int:
    """Lanes i of ``wanted`` whose value differs from that of lane i + shift in at most two bits.

    ``planes[b]`` holds bit b of every lane. Two difference planes at a time go
    through a carry-save adder into ones and twos; a carry out of twos, or both
    set, means three or more. The block is left once no wanted lane can be in
    reach any more.
    """
    ones = twos = over = 0
    for b in range(0, 64, 2):
        x, y = planes[b] ^ planes[b] >> shift, planes[b + 1] ^ planes[b + 1] >> shift
        half = ones ^ x
        carry = (ones & x) | (half & y)
        ones = half ^ y
        over |= twos & carry
        twos ^= carry
        if b % 8 == 6:
            wanted &= ~(over | (ones & twos))
            if not wanted:
                return 0
    return wanted


def _forest(bucket: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
    """Links (value, root) that span the components within each bucket; rows are sorted by bucket."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (up := parent.get(i, i)) != i:
            parent[i] = parent.get(up, up)
            i = up
        return i

    sizes = np.bincount(bucket)
    rows = np.flatnonzero(sizes[bucket] > 1)
    shift, reach = 1, 1
    while len(rows):
        vals, own = values[rows], bucket[rows]
        planes = [_plane((vals >> np.uint64(b)) & np.uint64(1) == 1) for b in range(64)]
        reach = min(reach * 2, int(sizes[own].max()))
        while shift <= reach:
            same = np.zeros(len(rows), dtype=bool)
            if shift < len(rows):
                same[:-shift] = own[:-shift] == own[shift:]
            found = within_two(planes, shift, _plane(same))
            for i in _lanes(found, len(rows)).tolist() if found else ():
                a, b = root(int(rows[i])), root(int(rows[i + shift]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
            shift += 1
        rows = rows[sizes[own] > shift]
    return [(int(values[i]), int(values[root(i)])) for i in list(parent) if root(i) != i]


def _edges(rows: np.ndarray) -> np.ndarray:
    """Where a new bucket starts, but for the first."""
    return np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1


def _links(rows: np.ndarray) -> pa.RecordBatch:
    bucket = np.zeros(len(rows), dtype=np.int64)
    bucket[_edges(rows)] = 1
    found = _forest(np.cumsum(bucket), rows[:, 2].astype(np.uint64))
    return pa.RecordBatch.from_arrays([
        pa.array([_signed(pair[side]) for pair in found], pa.int64()) for side in (0, 1)], ["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tag, val, fp) sorted by bucket (tag, val) -> links (a, b); whole buckets, about LANES rows at a time."""
    held = np.zeros((0, 3), dtype=np.int64)
    for batch in batches:
        held = np.concatenate([held, np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns])])
        if len(held) >= LANES and len(edges := _edges(held)):
            yield _links(held[:edges[-1]])
            held = held[edges[-1]:]
    if len(held):
        yield _links(held)


def _dealt(rows: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    return rows.select(F.explode(F.array(*[
        F.struct(F.lit(tag).alias("tag"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("val"))
        for tag, mask in masks])).alias("k"), "fp").select("k.tag", "k.val", "fp")


def near_links(fps: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) whose closure is that of all pairs within two bits."""
    dealt = stash(_dealt(fps, list(enumerate(BLOCK_MASKS))))
    hot = stash(dealt.groupBy("tag", "val").count().where(F.col("count") > bucket_rows).select("tag", "val"))
    finer = [_dealt(dealt.where(F.col("tag") == tag).join(hot, ["tag", "val"], "left_semi").select("fp"),
                    [(100 * (tag + 1) + i, m) for i, m in enumerate(finer_masks(mask))])
             for tag, mask in enumerate(BLOCK_MASKS)] if hot.limit(1).count() else []
    rows = dealt.join(hot, ["tag", "val"], "left_anti")
    for more in finer:
        rows = rows.union(more)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "tag", "val").sortWithinPartitions("tag", "val").mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; links at two or fewer differing bits.

    ``component_id`` is the least doc_id reachable over links. Null texts are
    empty ones; texts without words have fingerprint zero and link like any
    other. Equal fingerprints are one class however many rows have them. A null
    doc_id keeps its row; it is never a component_id unless all of its
    component are null. Other columns of ``docs`` are not read.
    """
    marked = stash(fingerprints(docs, id_col, text_col, shingle))
    classes = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = stash(connected_components(near_links(classes.select("fp"), bucket_rows)))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(stash(rooted.join(least, "root").select("fp", "component_id")), "fp").select(
        "doc_id", "fp", "component_id")


def op5(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
