"""Importance resampling towards a target text, over hashed n-gram buckets.

A batch's n-grams are interned in an open-addressed NumPy table: xxhash64 keys,
linear probing, and a comparison of the bytes themselves before two occurrences
share a slot. A slot carries its bucket and its count, so buckets are hashed once
per distinct n-gram of a batch. The first pass sums slot counts into the buckets
of corpus and target; the second gathers each occurrence's gain through its slot
id. Only the gains, one number a bucket, are on the driver and broadcast.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import ready, stash

WORD_BYTES = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))
LANES = 1 << 17
TAILS = np.array([(1 << 8 * n) - 1 for n in range(8)], dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and all code points from U+0080 on."""
    return (text or "").encode().lower().translate(WORD_BYTES).split()


class Interned:
    """Byte strings of one buffer, each distinct one in a slot of an open-addressed table."""

    def __init__(self, data: bytes, room: int) -> None:
        padded = np.frombuffer(data + b"\0" * 8, dtype=np.uint8)
        self.data = data
        self.words = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
        size = 1 << max(4, (2 * room).bit_length())
        self.key = np.zeros(size, dtype=np.uint64)
        self.start = np.zeros(size, dtype=np.int64)
        self.length = np.full(size, -1, dtype=np.int64)
        self.claim = np.zeros(size, dtype=np.int64)
        self.count = np.zeros(size, dtype=np.int64)
        self.bucket = np.zeros(size, dtype=np.int64)

    def _same_bytes(self, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
        same = np.ones(len(x), dtype=bool)
        left, at = np.arange(len(x)), 0
        while len(left := left[length[left] > at]):
            differ = self.words[x[left] + at] ^ self.words[y[left] + at]
            rest = length[left] - at
            short = rest < 8
            differ[short] &= TAILS[rest[short]]
            same[left[differ != 0]] = False
            left = left[differ == 0]
            at += 8
        return same

    def add(self, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The slot of every occurrence; an unseen string takes the first free slot from its key on."""
        mask = np.uint64(len(self.key) - 1)
        slot = (keys & mask).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            at = slot[open_]
            free = self.length[at] < 0
            claims, asked = open_[free], at[free]
            self.claim[asked] = claims  # one of several claims on a slot stays
            by = claims[self.claim[asked] == claims]
            taken = slot[by]
            self.key[taken], self.start[taken], self.length[taken] = keys[by], starts[by], lengths[by]
            same = (self.key[at] == keys[open_]) & (self.length[at] == lengths[open_])
            like = np.flatnonzero(same)
            same[like] = self._same_bytes(self.start[at[like]], starts[open_[like]], lengths[open_[like]])
            open_ = open_[~same]
            slot[open_] = (slot[open_] + 1) & int(mask)
        self.count += np.bincount(slot, minlength=len(self.count))
        return slot

    def hash_buckets(self, buckets: int) -> None:
        """Fill the bucket slots: crc32 of each distinct string."""
        used = np.flatnonzero(self.length >= 0)
        data, crc = self.data, zlib.crc32
        self.bucket[used] = [crc(data[s:s + n]) % buckets for s, n in zip(
            self.start[used].tolist(), self.length[used].tolist(), strict=True)]


def interned(words: list[bytes], owner: np.ndarray, fresh: np.ndarray, width: int, buckets: int,
             key: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> tuple[Interned, np.ndarray, np.ndarray]:
    """Table, slot of each n-gram occurrence, and its document.

    ``owner`` is the document of each word; an n-gram starts at a ``fresh`` word and stays in its document.
    """
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans, keys, docs = [], [], []
    for n in range(1, width + 1):
        last = len(words) - n + 1
        if last <= 0:
            break
        at = np.flatnonzero((owner[:last] == owner[n - 1:]) & fresh[:last])
        s, e = starts[at], ends[at + n - 1]
        grams = words if n == 1 and len(at) == len(words) else [data[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)]
        keys.append(np.fromiter(map(key, grams), np.uint64, len(at)))
        spans.append((s, e - s))
        docs.append(owner[at])
    keys = np.concatenate(keys)
    table = Interned(data, len(keys))
    slots = table.add(keys, *(np.concatenate(x) for x in zip(*spans, strict=True)))
    table.hash_buckets(buckets)
    return table, slots, np.concatenate(docs)


def portions(texts: list[str | None], width: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(words, document of each, whether n-grams start there): about LANES words at a time, long texts in pieces."""
    words: list[bytes] = []
    owners, fresh, held = [], [], 0
    for doc, text in enumerate(texts):
        own = words_of(text)
        for at in range(0, len(own), LANES):
            piece = own[at:at + LANES + width - 1]
            if held and held + len(piece) > LANES:
                yield words, np.concatenate(owners), np.concatenate(fresh)
                words, owners, fresh, held = [], [], [], 0
            words += piece
            held += len(piece)
            owners.append(np.full(len(piece), doc))
            fresh.append(np.arange(len(piece)) < LANES)
            if at + LANES < len(own):  # the next piece of this text must not touch this one
                yield words, np.concatenate(owners), np.concatenate(fresh)
                words, owners, fresh, held = [], [], [], 0
    if held:
        yield words, np.concatenate(owners), np.concatenate(fresh)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bucket_counts(texts: DataFrame, width: int, buckets: int) -> dict[int, int]:
    """Occurrences of n-grams by bucket: every task sums its own, Spark adds the tasks' sums."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in few_rows(batches):
            for words, owner, fresh in portions(batch.column(0).to_pylist(), width):
                table, _, _ = interned(words, owner, fresh, width, buckets)
                np.add.at(sums, table.bucket, table.count)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], ["bucket", "n"])

    rows = ready(texts).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    return {r["bucket"]: r["n"] for r in rows}


def gains_of(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    s_all, t_all = sum(corpus.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log(float(target.get(b, 0) + 1) * (s_all + buckets) / (
        float(corpus.get(b, 0) + 1) * (t_all + buckets)))) for b in range(buckets)], dtype=np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, width: int, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_words, n_features, weight) of every document."""
    spark, buckets = docs.sparkSession, len(gains)
    sent = spark.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in few_rows(batches):
            n_words, found, weight = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for words, owner, fresh in portions(batch.column(2).to_pylist(), width):
                table, slots, doc = interned(words, owner, fresh, width, buckets)
                np.add.at(weight, doc, gain[table.bucket][slots])
                found += np.bincount(doc, minlength=len(found))
                n_words += np.bincount(owner[fresh], minlength=len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (n_words, found, weight))],
                                             ["row", "id", "n_words", "n_features", "weight"])

    rows = ready(docs).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", rows.schema["id"].dataType), *[
        T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])
    return rows.mapInArrow(weigh, schema)


def gumbel(seed: int) -> F.Column:
    """Thousandths of a Gumbel draw from sha256 of seed and id, rounded down."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(share)))


def resample(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = 10_000, percent: int = 10,
             least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ``target`` has a text column of the same name.

    Features are all runs of 1 to ``width`` words, repeats counted. ``percent``
    of the documents with ``least_words`` words are drawn, highest scores first,
    ties to the smaller id, then nulls, then the first row as read; ranks of the
    others are null. A null text has no words; a null id draws as the empty
    string; rows that share an id share their draw. Empty tables give no rows,
    an empty target gains by rarity alone. Other columns are not read.
    """
    gains = gains_of(bucket_counts(docs.select(text_col), width, buckets), bucket_counts(target.select(text_col), width, buckets), buckets)
    scored = stash(weighed(docs, gains, width, id_col, text_col).withColumn("score", F.col("weight") + gumbel(seed)))
    able = F.col("n_words") >= least_words
    draws = scored.where(able).count() * percent // 100
    order = [(~able), F.col("score").desc(), F.col("id").isNull(), F.col("id"), F.col("row")]
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stash(scored.repartitionByRange(slices, *order).withColumn("slice", F.spark_partition_id()))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row for each slice
    starts = dealt.groupBy("slice").count().select("slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("slice").orderBy(*order)) + F.col("before")
    return dealt.join(F.broadcast(starts), "slice").withColumn("place", place.cast("long")).select(
        F.col("id").alias("doc_id"), "n_features", "weight", "score",
        F.when(able & (F.col("place") <= draws), F.col("place")).alias("rank"))


def op11(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark)


SQL = r"""
with recursive bytes as (select b from range(256) r(b)),
crc_step(b, c, i) as (
  select b, b, 0 from bytes union all
  select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i + 1 from crc_step where i < 8),
crc_table as (select b, c from crc_step where i = 8),
texts as (
  select 'd' as side, doc_id, text from documents union all select 'b', null, text from benchmark),
said as (
  select side, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from texts),
spoken as (select side, doc_id, unnest(words) as word from said),
known as (select distinct word, hex(word) as h from spoken),
crc(word, h, i, c) as (
  select word, h, 0, 4294967295::bigint from known union all
  select word, h, i + 1, xor(k.c >> 8, t.c) from crc k join crc_table t on t.b = xor(k.c & 255,
    16 * (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)
  where 2 * i < length(h)),
bucketed as (select word, xor(c, 4294967295) % 10000 as bucket from crc where 2 * i = length(h)),
counts as (
  select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t
  from spoken join bucketed using (word) group by bucket),
totals as (select sum(s)::bigint as s_all, sum(t)::bigint as t_all from counts),
gains as (
  select bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::double / ((s + 1) * (t_all + 10000))::double))::bigint as gain
  from counts, totals),
word_gains as (select word, gain from bucketed join gains using (bucket)),
weights as (
  select doc_id, sum(gain)::bigint as weight from spoken join word_gains using (word) where side = 'd' group by doc_id),
scored as (
  select doc_id, len(words)::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) + 0.5) / 4294967296)))::bigint as score
  from said left join weights using (doc_id) where side = 'd'),
ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as place from scored where n_features >= 20)
select doc_id, n_features, weight, score,
  case when place <= (select count(*) * 10 // 100 from ranked) then place end as rank
from scored left join ranked using (doc_id)
"""
