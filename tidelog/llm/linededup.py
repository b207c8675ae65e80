"""Reversible line deduplication: sharded cuckoo filters in front of exact reference counts.

An index is a list of segments, one for each batch of documents, and one cuckoo
filter for each shard of the line keys. A segment holds postings (key, doc_id),
the exact memory, and counts (key, n_docs, keeper), their sums. A batch is
reduced to its distinct keys; each shard's filter splits them into keys that are
certainly new and keys that may be known. Only the latter ever meet the exact
tables of earlier segments: their counts are the ones that must be added up, all
other counts stand alone as they were written. Earlier segments are never
rewritten by an insertion. Taking documents out lowers counts, finds the next
keeper from the postings, and removes the keys that nobody holds any more from
the filters, so inserting and then deleting leaves the index as it was.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import BLANKS, ascii_lower, free_name, join_counted, ready, scope, stash

LEAST_CHARS = 20
LEAST_DOCS = 3
SHARD_KEYS = 100_000
BATCHES = 3
SLOTS = 4
KICKS = 500


def line_key(line: str, least_chars: int = LEAST_CHARS) -> bytes | None:
    """128-bit digest of the stripped, lower-cased line; None below ``least_chars`` code points."""
    key = line.strip(BLANKS)
    return hashlib.md5(ascii_lower(key).encode()).digest() if len(key) >= least_chars else None


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints; a full table gets a larger one beside it."""

    def __init__(self, blob: bytes = b"", expected: int = 0):
        self.tables: list[array] = []
        while blob:
            size, blob = int.from_bytes(blob[:8], "little"), blob[8:]
            self.tables.append(array("H", blob[:2 * size]))
            blob = blob[2 * size:]
        if not self.tables:
            self._grow(expected)

    def _grow(self, expected: int) -> None:
        buckets = 16
        while buckets * SLOTS * 0.9 < expected:
            buckets *= 2
        self.tables.append(array("H", bytes(2 * SLOTS * buckets)))

    def blob(self) -> bytes:
        return b"".join(len(t).to_bytes(8, "little") + t.tobytes() for t in self.tables)

    @staticmethod
    def _mark(key: bytes) -> tuple[int, int]:
        return int.from_bytes(key[:8], "little"), int.from_bytes(key[8:10], "little") or 1

    @staticmethod
    def _other(bucket: int, mark: int, buckets: int) -> int:
        return bucket ^ mark * 0x5BD1E995 % buckets

    def _places(self, table: array, at: int, mark: int) -> tuple[int, int]:
        buckets = len(table) // SLOTS
        first = at % buckets
        return first, self._other(first, mark, buckets)

    def __contains__(self, key: bytes) -> bool:
        at, mark = self._mark(key)
        return any(mark in t[SLOTS * b:SLOTS * b + SLOTS] for t in self.tables for b in self._places(t, at, mark))

    def _set(self, table: array, bucket: int, old: int, new: int) -> bool:
        for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if table[slot] == old:
                table[slot] = new
                return True
        return False

    def add(self, key: bytes) -> None:
        at, mark = self._mark(key)
        table = self.tables[-1]
        first, second = self._places(table, at, mark)
        if self._set(table, first, 0, mark) or self._set(table, second, 0, mark):
            return
        bucket, moves = first, []
        for kick in range(KICKS):
            slot = SLOTS * bucket + (kick + mark) % SLOTS
            moves.append((slot, table[slot]))
            table[slot], mark = mark, table[slot]
            bucket = self._other(bucket, mark, len(table) // SLOTS)
            if self._set(table, bucket, 0, mark):
                return
        for slot, before in reversed(moves):
            table[slot] = before
        self._grow(2 * len(table))
        self.add(key)

    def remove(self, key: bytes) -> None:
        at, mark = self._mark(key)
        for table in reversed(self.tables):
            if any(self._set(table, b, mark, 0) for b in self._places(table, at, mark)):
                return


POSTINGS = "shard long, key binary, doc_id long"
COUNTS = "shard long, key binary, n_docs long, keeper long, known boolean"
FILTERS = "shard long, filter binary"
KEY = ["shard", "key"]


@dataclass(frozen=True)
class LineIndex:
    """Segments (postings, counts) in the order of insertion, and filters (shard, filter).

    A count's ``known`` says that the filter may have held the key before: then,
    and only then, earlier segments may count the same key.
    """

    shards: int
    segments: tuple[tuple[DataFrame, DataFrame], ...]
    filters: DataFrame

    @property
    def postings(self) -> DataFrame:
        return _all([postings for postings, _ in self.segments])

    @property
    def counts(self) -> DataFrame:
        return merged(self).drop("known")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def empty_index(spark: SparkSession, shards: int) -> LineIndex:
    postings, counts, filters = (spark.createDataFrame([], s) for s in (POSTINGS, COUNTS, FILTERS))
    return LineIndex(shards, ((postings, counts),), filters)


def merged(index: LineIndex, least_docs: int = 1) -> DataFrame:
    """(shard, key, n_docs, keeper, known): exact counts of the keys that at least ``least_docs`` documents hold.

    Keys that a filter reported are added up over the segments; the others have one count.
    """
    rows = _all([counts for _, counts in index.segments])
    if len(index.segments) == 1:
        return rows.where(F.col("n_docs") >= least_docs)
    touched = stash(rows.where("known").select(*KEY).distinct())
    again = join_counted(rows, touched, KEY, "left_semi").groupBy(*KEY).agg(
        F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper")).withColumn("known", F.lit(True))
    alone = join_counted(rows.where((F.col("n_docs") >= least_docs) & ~F.col("known")), touched, KEY, "left_anti")
    return alone.unionByName(again.where(F.col("n_docs") >= least_docs))


def _keys(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, key): the distinct keys of each row."""
    for batch in batches:
        for part in range(0, batch.num_rows, 1024):
            rows = batch.slice(part, 1024)
            ids, keys = [], []
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                own = {line_key(line, least_chars) for line in text.split("\n")} - {None}
                keys += own
                ids += [doc] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards))


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, key), distinct; rows that share a doc_id are one document, rows without id or text have no key."""
    rows = ready(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(
        "doc_id is not null and text is not null")
    return rows.mapInArrow(lambda batches: _keys(batches, least_chars), "doc_id long, key binary").distinct()


def shards_for(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Shards of about SHARD_KEYS keys, from the number of line ends."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)).first()[0] or 0
    return max(1, -(-int(lines) // SHARD_KEYS))


def _passed(use_filters: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def passed(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        """One shard's keys, each with whether its filter may hold it, and the filter with the new ones, in a row of its own."""
        held = Cuckoo(bytes(filters["filter"].iloc[0]) if len(filters) else b"", len(keys))
        known = [not use_filters or bool(len(filters)) and bytes(k) in held for k in keys["key"]]
        for key, old in zip(keys["key"], known, strict=True):
            if not old:
                held.add(bytes(key))
        shard = int((keys if len(keys) else filters)["shard"].iloc[0])
        out = keys.assign(known=known, filter=None)
        return pd.concat([out, pd.DataFrame({"shard": [shard], "filter": [held.blob()]})], ignore_index=True)[
            ["shard", "key", "n_docs", "keeper", "known", "filter"]].astype({"n_docs": "Int64", "keeper": "Int64"})

    return passed


def _updated(filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    """One shard's filter after its keys came (sign 1) or went (sign -1)."""
    if not len(filters) and not len(keys):
        return pd.DataFrame({"shard": [], "filter": []})
    shard = int((filters if len(filters) else keys)["shard"].iloc[0])
    held = Cuckoo(bytes(filters["filter"].iloc[0]) if len(filters) else b"", len(keys))
    for key, sign in zip(keys["key"], keys["sign"], strict=True):
        (held.add if sign > 0 else held.remove)(bytes(key))
    return pd.DataFrame({"shard": [shard], "filter": [held.blob()]})


def _filters(filters: DataFrame, keys: DataFrame, sign: int) -> DataFrame:
    changed = keys.select(*KEY).withColumn("sign", F.lit(sign))
    return stash(filters.groupBy("shard").cogroup(changed.groupBy("shard")).applyInPandas(_updated, FILTERS))


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))


def _appended(index: LineIndex, came: DataFrame, disjoint: bool, use_filters: bool = True) -> LineIndex:
    """The index with a segment for the written postings ``came``; ``disjoint``: none of its documents is held already."""
    split = stash(_counted(came).groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(
        _passed(use_filters), f"{COUNTS}, filter binary"))
    counts = split.where("filter is null").drop("filter")
    filters = split.where("filter is not null").select("shard", "filter")
    maybe = stash(counts.where("known").select(*KEY))
    if maybe.limit(1).count():
        earlier = _all([rows for _, rows in index.segments]).select(*KEY)
        sure = stash(join_counted(earlier, maybe, KEY, "left_semi").distinct())
        wrong = stash(maybe.join(sure, KEY, "left_anti"))
        if wrong.limit(1).count():  # the filter only seemed to hold them
            filters = _filters(filters, wrong, 1)
        if not disjoint:
            held = join_counted(index.postings, sure, KEY, "left_semi").join(came, [*KEY, "doc_id"], "left_semi")
            held = stash(held)
            if held.limit(1).count():
                came = stash(came.join(held, [*KEY, "doc_id"], "left_anti"))
                fresh = _counted(came).join(counts.select(*KEY, "known"), KEY)
                counts = stash(fresh.select(*[c.split()[0] for c in COUNTS.split(", ")]))
    return LineIndex(index.shards, (*index.segments, (came, counts)), filters)


def insert(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           least_chars: int = LEAST_CHARS, use_filters: bool = True) -> LineIndex:
    """The index with the documents of ``docs`` added; documents that it already holds change nothing.

    Shards are dealt anew where filters would come to hold more than twice
    SHARD_KEYS keys each. Without ``use_filters`` every key meets the exact
    tables: the same index, at a higher price.
    """
    came = stash(line_keys(docs, id_col, text_col, least_chars).withColumn("shard", _shard(index.shards)).select("shard", "key", "doc_id"))
    keys = sum(counts.count() for _, counts in index.segments) + came.count()
    if keys > 2 * SHARD_KEYS * index.shards:
        index = resharded(index, -(-keys // SHARD_KEYS))
        came = stash(came.withColumn("shard", _shard(index.shards)))
    return _appended(index, came, disjoint=False, use_filters=use_filters)


def resharded(index: LineIndex, shards: int) -> LineIndex:
    """The same index in one segment with another number of shards."""
    postings = stash(index.postings.withColumn("shard", _shard(shards)))
    counts = stash(merged(index).withColumn("shard", _shard(shards)).select(*[c.split()[0] for c in COUNTS.split(", ")]))
    none = index.filters.sparkSession.createDataFrame([], FILTERS)
    return LineIndex(shards, ((postings, counts),), _filters(none, counts, 1))


def delete(index: LineIndex, gone: DataFrame, id_col: str = "doc_id") -> LineIndex:
    """The index without the documents whose ids ``gone`` lists, in one segment; unknown ids change nothing."""
    ids = gone.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    went = stash(index.postings.join(ids, "doc_id", "left_semi").select("shard", "key", "doc_id"))
    postings = stash(index.postings.join(ids, "doc_id", "left_anti").select("shard", "key", "doc_id"))
    touched = stash(went.select(*KEY).distinct())
    before = merged(index)
    again = _counted(postings.join(touched, KEY, "left_semi")).join(before.select(*KEY, "known"), KEY)
    counts = stash(before.join(touched, KEY, "left_anti").unionByName(again))
    lost = touched.join(counts, KEY, "left_anti")
    return LineIndex(index.shards, ((postings, counts),), _filters(index.filters, lost, -1))


def to_drop(index: LineIndex, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, drop): the keys whose lines a document loses."""
    common = stash(merged(index, least_docs).select(*KEY, "keeper"))
    held = index.postings.join(common, KEY).where("doc_id <> keeper")
    return held.groupBy("doc_id").agg(F.collect_list("key").alias("drop"))


def strip_lines(text: str | None, drop: set[bytes], least_chars: int = LEAST_CHARS) -> tuple[int, int, str]:
    """(lines, lines dropped, the text that is left)."""
    lines = (text or "").split("\n")
    kept = [line for line in lines if line_key(line, least_chars) not in drop] if drop else lines
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def _stripped(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    rows = [strip_lines(t, set() if d is None else {bytes(k) for k in d}) for t, d in zip(texts, drops, strict=True)]
    return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])


def _digested(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    rows = [strip_lines(t, set() if d is None else {bytes(k) for k in d}) for t, d in zip(texts, drops, strict=True)]
    return pd.DataFrame([(n, k, hashlib.sha256(t.encode()).hexdigest()) for n, k, t in rows],
                        columns=["n_lines", "n_dropped", "kept_sha256"])


def stripped(text: Column, drop: Column) -> Column:
    return F.pandas_udf(_stripped, "n_lines long, n_dropped long, kept string")(text, drop)


def digested(text: Column, drop: Column) -> Column:
    return F.pandas_udf(_digested, "n_lines long, n_dropped long, kept_sha256 string")(text, drop)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, use_filters: bool = True) -> LineIndex:
    """An index of ``docs``, put in by ``batches`` of documents, so that no filter is asked about keys it has just been given."""
    index = empty_index(docs.sparkSession, shards_for(docs, id_col, text_col))
    came = line_keys(docs, id_col, text_col).select(
        _shard(index.shards).alias("shard"), "key", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch"))
    came = stash(came)
    for batch in range(batches):
        index = _appended(index, came.where(F.col("batch") == batch).drop("batch"), disjoint=True, use_filters=use_filters)
    return index


def dropped_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, drop), written; the index that says so is gone again."""
    with scope() as kept:
        drops = stash(to_drop(build(docs, id_col, text_col), least_docs))
        kept.append(drops)
    return drops


def rewrite(docs: DataFrame, drops: DataFrame, result: Callable[[Column, Column], Column], id_col: str = "doc_id",
            text_col: str = "text", out: str = "lines") -> DataFrame:
    """``docs`` with the struct ``out`` = ``result`` of the text and of the keys (doc_id, drop) that its lines lose."""
    holder, gone = free_name(docs, "holder"), free_name(docs, "drop")
    drops = drops.select(F.col("doc_id").alias(holder), F.col("drop").alias(gone))
    # merged at every size: what is dropped grows with the documents, so it is never a side to broadcast
    joined = docs.hint("merge").join(drops, F.col(id_col) == F.col(holder), "left")
    return joined.withColumn(out, result(F.col(text_col), F.col(gone))).drop(holder, gone)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines dropped from the text; other columns, and rows without id, as they were.

    A null text stays null. Texts of which no line is left become empty.
    """
    out = free_name(docs, "lines")
    done = rewrite(docs, dropped_keys(docs, id_col, text_col), stripped, id_col, text_col, out=out)
    kept = F.when(F.col(text_col).isNotNull(), F.col(out)["kept"])
    return done.withColumn(text_col, kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row; rows that share a doc_id count as one document."""
    docs = docs.select("doc_id", "text")
    done = rewrite(docs, dropped_keys(docs), digested)
    return done.select("doc_id", "lines.n_lines", "lines.n_dropped", "lines.kept_sha256")
