"""Exact repeats of long byte strings, by common-prefix interval trees over sharded suffix arrays.

Which strings meet in one shard is decided by content. Every window of
``length`` bytes picks its least-hashed ``ANCHOR``-byte string; equal windows pick
equal anchors. Neighbouring windows with the same anchor form a unit, about
one for every 170 bytes. Three steps, each exact:

1. Units whose anchor occurs once have no repeated window and go.
2. Units that occur twice as a whole are repeated in every window.
3. The other units of a repeated anchor meet (each whole unit of step 2 once) in
   the shard of that anchor. There a suffix array of their windows is sorted, its
   common-prefix intervals are stack-scanned, and each interval of ``length`` or
   more whose occurrences differ in the byte to the left is a maximal repeat,
   put out with all its occurrences.

Equal windows have their anchor at the same offset, so a shard's suffixes are
sorted offset by offset, a bounded number at a time. An anchor with more than
``SHARD_UNITS`` different units (a passage that very many texts surround) would
still make a shard too large; its windows are counted by hash over all tasks
instead, with the same result. Hashes are 64 bits and compared only within one
anchor.

Passages that documents share are often shorter than ``length`` bytes. ``shared``
finds every run of ``SHARED`` words that stands in another document too: the same
units, of word numbers instead of bytes, with all windows of step 3 counted by hash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import BLANKS, drop, ready, scope, stash, text_of

LENGTH = 400
ANCHOR = 64
SHARD_UNITS = 4096
SHARED = 51
WORD_ANCHOR = 8
SORTED_AT_ONCE = 1 << 14
CHUNK = 1 << 20
UNIT = "d long, place long, h long, u long"
LOW = np.uint64(0xFFFFFFFF)
BLANK = re.compile(f"[{BLANKS}]".encode())
IS_BLANK = np.isin(np.arange(256), np.frombuffer(BLANKS.encode(), dtype=np.uint8))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64, and a number for each byte."""
    base = 0x9E3779B97F4A7C15
    up = np.full(n, base, dtype=np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64), mixed(
        np.arange(1, 257, dtype=np.uint64) * np.uint64(base))


class Prints:
    """Hashes of any stretch of ``data`` (bytes, or 64-bit numbers), from one running sum."""

    def __init__(self, data: np.ndarray):
        size = max(2 * CHUNK, 1 << (len(data) + 1).bit_length())
        up, self.down, numbers = _powers(size)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        values = numbers[data] if data.dtype == np.uint8 else data
        np.cumsum(values * up[:len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def unit_runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(first window, windows, bytes before the anchor, anchor hash, unit hash) of the units of texts laid end to end.

    ``ends`` are the ends of the texts.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none, none
    prints = Prints(data)
    at = np.arange(len(data) - anchor + 1)
    grams = prints.of(at, at + anchor)
    least = sliding_least((grams & ~LOW) | at.astype(np.uint64), length - anchor + 1)
    picked = (least & LOW).astype(np.int64)
    p = np.arange(len(picked))
    inside = np.zeros(len(data), dtype=bool)
    begin = 0
    for end in ends.tolist():
        inside[begin:max(begin, end - length + 1)] = True
        begin = end
    inside = inside[:len(picked)]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (picked[1:] != picked[:-1])
    first = p[new]
    if not len(first):
        return none, none, none, none, none
    stop = np.flatnonzero(inside & np.append(~inside[1:] | new[1:], True))
    windows = stop - first + 1
    h = grams[picked[first]]
    lead = picked[first] - first
    shape = (lead << 32 | windows).astype(np.uint64)
    u = mixed(prints.of(first, stop + length) ^ mixed(shape))
    return first, windows, lead, h.view(np.int64), u.view(np.int64)


#: A place packs the unit's first window (32 bits), its windows and the bytes before its anchor (9 each), and a mark (14).
FIELD, MARK_BITS = 9, 14


def check(raw: bytes) -> int:
    """The mark: a few bits of the text, which tell rows with the same id apart."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=2).digest(), "little") & (1 << MARK_BITS) - 1


def unpacked(place: int) -> tuple[int, int, int, int]:
    """(first window, windows, bytes before the anchor, mark)."""
    ones = (1 << FIELD) - 1
    return place >> 32, place >> MARK_BITS + FIELD & ones, place >> MARK_BITS & ones, place & (1 << MARK_BITS) - 1


def placed(data: np.ndarray, sizes: list[int], marks: np.ndarray, shift: np.ndarray, length: int, anchor: int
           ) -> tuple[np.ndarray, ...]:
    """(part, place, anchor hash, unit hash) of the units of parts laid end to end; ``shift``: where a part starts in its text."""
    ends = np.cumsum(sizes)
    first, windows, lead, h, u = unit_runs(data, ends, length, anchor)
    own = np.searchsorted(ends, first, side="right")
    begin = np.concatenate([[0], ends[:-1]])
    place = (first - begin[own] + shift[own]) << 32 | windows << MARK_BITS + FIELD | lead << MARK_BITS | marks[own]
    return own, place, h, u


def _units(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(d, text) -> units; texts are laid end to end, long ones cut into overlapping chunks."""
    def told(parts: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        """parts: (id, mark, where the part starts in its text, bytes)."""
        ids, marks, shift = (np.array([x[i] for x in parts], dtype=np.int64) for i in range(3))
        own, place, h, u = placed(np.frombuffer(b"".join(x[3] for x in parts), dtype=np.uint8),
                                  [len(x[3]) for x in parts], marks, shift, length, ANCHOR)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[own], place, h, u)], ["d", "place", "h", "u"])

    parts, size = [], 0
    for batch in batches:
        for part in range(0, batch.num_rows, 256):
            rows = batch.slice(part, 256)
            for d, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                raw = text.encode()
                mark = check(raw) if len(raw) >= length else 0
                for at in range(0, len(raw) - length + 1, CHUNK):
                    cut = raw[at:at + CHUNK + length - 1]
                    parts.append((d, mark, at, cut))
                    size += len(cut)
                    if size >= CHUNK:
                        yield told(parts)
                        parts, size = [], 0
    if parts:
        yield told(parts)


def word_numbers(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit number) of each word, which ASCII white space bounds; about CHUNK bytes at a time."""
    starts, numbers, at = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)], 0
    while at < len(raw):
        gap = BLANK.search(raw, at + CHUNK)
        stop = gap.start() if gap else len(raw)
        data = np.frombuffer(raw, dtype=np.uint8, count=stop - at, offset=at)
        edges = np.flatnonzero(np.diff(IS_BLANK[data], prepend=True, append=True))
        starts.append(edges[::2] + at)
        numbers.append(Prints(data).of(edges[::2], edges[1::2]))
        at = stop
    return np.concatenate(starts), np.concatenate(numbers)


def _word_units(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(d, row, text) -> units of words; a text of very many words is cut into overlapping parts."""
    def told(parts: list[tuple[int, int, int, int, np.ndarray]]) -> pa.RecordBatch:
        """parts: (id, row, mark, where the part starts in its text, word numbers)."""
        ids, rows, marks, shift = (np.array([x[i] for x in parts], dtype=np.int64) for i in range(4))
        own, place, h, u = placed(np.concatenate([x[4] for x in parts]), [len(x[4]) for x in parts],
                                  marks, shift, words, WORD_ANCHOR)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[own], rows[own], place, h, u)],
                                          ["d", "row", "place", "h", "u"])

    parts, size = [], 0
    for batch in batches:
        for part in range(0, batch.num_rows, 256):
            rows = batch.slice(part, 256)
            raws = [text.encode() for text in rows.column(2).to_pylist()]
            starts, numbers = word_numbers(b"\n".join(raws))
            last = np.searchsorted(starts, np.cumsum([len(raw) + 1 for raw in raws])).tolist()
            for d, row, raw, begin, end in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), raws,
                                               [0, *last[:-1]], last, strict=True):
                mark = check(raw) if end - begin >= words else 0
                for at in range(0, end - begin - words + 1, CHUNK):
                    cut = numbers[begin + at:min(end, begin + at + CHUNK + words - 1)]
                    parts.append((d, row, mark, at, cut))
                    size += len(cut)
                    if size >= CHUNK // 8:
                        yield told(parts)
                        parts, size = [], 0
    if parts:
        yield told(parts)


def _word_windows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(d, text, wanted units) -> their windows (h, w, d, mark, start, low, high, alone)."""
    for batch in batches:
        for part in range(0, batch.num_rows, 64):
            rows = batch.slice(part, 64)
            wanted = rows.column(2)
            last = np.cumsum(pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
            units = wanted.flatten()
            place, h, low, high, alone = (units.field(x).to_numpy(zero_copy_only=False)
                                          for x in ("place", "h", "low", "high", "alone"))
            marks, first = place & (1 << MARK_BITS) - 1, place >> 32
            windows = place >> MARK_BITS + FIELD & (1 << FIELD) - 1
            found: list[tuple[np.ndarray, ...]] = []
            for d, text, begin, end in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(),
                                           [0, *last[:-1].tolist()], last.tolist(), strict=True):
                raw = text.encode()
                unit = begin + np.flatnonzero(marks[begin:end] == check(raw))
                n = windows[unit]
                at = np.repeat(first[unit] - np.cumsum(n) + n, n) + np.arange(n.sum())
                w = Prints(word_numbers(raw)[1]).of(at, at + words).view(np.int64)
                unit = np.repeat(unit, n)
                found.append((h[unit], w, np.full(len(at), d), marks[unit], at, low[unit], high[unit], alone[unit]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)],
                                             ["h", "w", "d", "mark", "start", "low", "high", "alone"])


def suffix_arrays(texts: list[bytes], windows: list[int], leads: list[int]) -> Iterator[list[tuple[bytes, int, int]]]:
    """Sorted suffixes (bytes, text, start) of the first windows of the texts.

    ``leads``: bytes before the anchor. Suffixes whose anchor lies equally far
    ahead come together, as many offsets at a time as SORTED_AT_ONCE allows.
    """
    by_offset: dict[int, list[tuple[int, int]]] = {}
    for i, (n, lead) in enumerate(zip(windows, leads, strict=True)):
        for at in range(n):
            by_offset.setdefault(lead - at, []).append((i, at))
    held: list[tuple[int, int]] = []
    for _, starts in sorted(by_offset.items()):
        if len(starts) > 1:
            held += starts
            if len(held) >= SORTED_AT_ONCE:
                yield sorted((texts[i][at:], i, at) for i, at in held)
                held = []
    if held:
        yield sorted((texts[i][at:], i, at) for i, at in held)


def maximal_repeats(texts: list[bytes], suffixes: list[tuple[bytes, int, int]], length: int = LENGTH
                    ) -> Iterator[tuple[int, int, int]]:
    """(repeat length, first, after the last): the maximal repeats of a suffix array, each a run of all its occurrences.

    A stack holds the open common-prefix intervals while the array is read once,
    each with the byte to the left that its occurrences share so far, or None if
    they differ (a text's start has none and differs from all). An interval is
    put out when it closes, inner ones first, if its left bytes differ.
    """
    def before(position: int) -> int | None:
        _, i, at = suffixes[position]
        return texts[i][at - 1] if at else None

    stack: list[list] = []  # [common prefix, first position, shared byte to the left], longer prefixes on top
    for position in range(1, len(suffixes) + 1):
        common = 0
        if position < len(suffixes):
            a, b = suffixes[position - 1][0], suffixes[position][0]
            if a[:length] == b[:length]:
                common = _common(a, b)
        first, left = position - 1, before(position - 1)
        while stack and stack[-1][0] > common:
            size, first, shared = stack.pop()
            left = shared if shared == left else None
            if left is None:
                yield size, first, position
        if common >= length:
            if stack and stack[-1][0] == common:
                if stack[-1][2] != left:
                    stack[-1][2] = None
            else:
                stack.append([common, first, left])


def covered(texts: list[bytes], windows: list[int], leads: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each text the merged spans that its occurrences of maximal repeats cover."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for suffixes in suffix_arrays(texts, windows, leads):
        onward = list(range(len(suffixes) + 1))  # the next suffix that no inner, longer repeat has
        for size, first, after in maximal_repeats(texts, suffixes, length):
            position = first
            while position < after:
                if onward[position] == position:
                    _, i, at = suffixes[position]
                    spans[i].append((at, at + size))
                    onward[position] = after
                    position += 1
                else:
                    further = onward[position]
                    onward[position] = max(further, after)
                    position = further
    return [merged(own, len(text)) for own, text in zip(spans, texts, strict=True)]


def _common(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(h, d, place, alone, raw) sorted by h -> spans (d, mark, start, stop) of the units that stand alone."""
    names = ["d", "mark", "start", "stop"]

    def solved(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
        shapes = [unpacked(r[2]) for r in rows]
        found = covered([r[4] for r in rows], [x[1] for x in shapes], [x[2] for x in shapes], length)
        return [(row[1], mark, start + a, start + b) for row, (start, _, _, mark), own in zip(rows, shapes, found, strict=True)
                if row[3] for a, b in own]

    held: list[tuple] = []
    for batch in batches:
        rows = list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
        found: list[tuple[int, int, int, int]] = []
        for h, group in groupby(rows, key=lambda r: r[0]):
            if held and held[0][0] != h:
                found += solved(held)
                held = []
            held += group
        yield _spans(found, names)
    if held:
        yield _spans(solved(held), names)


def _spans(found: list[tuple[int, int, int, int]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], names)


def _regions(texts: pd.Series, wanted: pd.Series, length: int) -> pd.Series:
    out = []
    for text, places in zip(texts, wanted, strict=True):
        raw = text.encode()
        mark = check(raw)
        found = []
        for w in places:
            start, windows, _, own = unpacked(w["place"])
            if own == mark:
                found.append({**w, "raw": raw[start:start + windows + length - 1]})
        out.append(found)
    return pd.Series(out)


def _window_hashes(raws: pd.Series, length: int) -> pd.Series:
    out = []
    for raw in raws:
        data = np.frombuffer(raw, dtype=np.uint8)
        at = np.arange(len(data) - length + 1)
        out.append(Prints(data).of(at, at + length).view(np.int64))
    return pd.Series(out)


REGION = "array<struct<place:bigint,h:bigint,alone:boolean,wide:boolean,raw:binary>>"


def repeated_spans(texts: DataFrame, candidates: DataFrame, length: int = LENGTH,
                   shard_units: int = SHARD_UNITS) -> DataFrame:
    """(d, mark, start, stop): spans whose union is every byte that a repeated window covers.

    ``candidates`` are the units of ``texts`` (d, text) whose anchor occurs more than once.
    """
    mark, start = F.col("place").bitwiseAND(F.lit((1 << MARK_BITS) - 1)), F.shiftright("place", 32)
    windows = F.shiftright("place", MARK_BITS + FIELD).bitwiseAND(F.lit((1 << FIELD) - 1))
    classes = stash(candidates.groupBy("h", "u").agg(
        F.count("*").alias("copies"), F.min(F.struct("d", "place")).alias("one")))
    whole = candidates.join(classes.where("copies > 1").select("h", "u"), ["h", "u"], "left_semi").select(
        "d", mark.alias("mark"), start.alias("start"), (start + windows + length - 1).alias("stop"))

    groups = classes.groupBy("h").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).where(
        "kinds > 1 and least = 1").select("h", (F.col("kinds") > shard_units).alias("wide"))
    needed = stash(classes.join(groups, "h").select(
        "one.d", "one.place", "h", (F.col("copies") == 1).alias("alone"), "wide"))

    @F.pandas_udf(REGION)
    def regions(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        return _regions(texts, wanted, length)

    @F.pandas_udf("array<bigint>")
    def hashes(raws: pd.Series) -> pd.Series:
        return _window_hashes(raws, length)

    per_doc = needed.groupBy("d").agg(F.collect_list(F.struct("place", "h", "alone", "wide")).alias("wanted"))
    cut = stash(texts.join(per_doc, "d").select("d", F.explode(regions("text", "wanted")).alias("r")).select(
        "r.h", "d", "r.place", "r.alone", "r.wide", "r.raw"))

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded = cut.where("not wide").select("h", "d", "place", "alone", "raw").repartition(n, "h").sortWithinPartitions(
        "h").mapInArrow(lambda batches: _shards(batches, length), "d long, mark long, start long, stop long")

    windowed = cut.where("wide").select("h", "d", "place", "alone", F.posexplode(hashes("raw")).alias("i", "w"))
    twice = windowed.groupBy("h", "w").agg(F.count("*").alias("n")).where("n > 1").select("h", "w")
    counted = windowed.where("alone").join(twice, ["h", "w"], "left_semi").select(
        "d", mark.alias("mark"), (start + F.col("i")).alias("start"), (start + F.col("i") + length).alias("stop"))
    return whole.union(sharded).union(counted)


def shared_spans(texts: DataFrame, words: int = SHARED) -> DataFrame:
    """(d, mark, start, stop), in words: spans whose union is every word of a run of ``words`` words that another row has too.

    ``texts``: (d, text). Equal runs have equal 64-bit hashes.
    """
    mark, start = F.col("place").bitwiseAND(F.lit((1 << MARK_BITS) - 1)), F.shiftright("place", 32)
    windows = F.shiftright("place", MARK_BITS + FIELD).bitwiseAND(F.lit((1 << FIELD) - 1))
    span = [F.min("row").alias("low"), F.max("row").alias("high")]
    # the number only tells rows apart, within this one pass: rows of one id and text are documents of their own too
    units = stash(ready(texts).select("d", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(
        lambda batches: _word_units(batches, words), "d long, row long, place long, h long, u long"))
    often = stash(units.groupBy("h").agg(*span).where("low < high").select("h"))
    candidates = stash(units.join(often, "h", "left_semi"))
    drop(units, often)
    classes = stash(candidates.groupBy("h", "u").agg(*span, F.min(F.struct("d", "place")).alias("one")))
    whole = candidates.join(classes.where("low < high").select("h", "u"), ["h", "u"], "left_semi").select(
        "d", mark.alias("mark"), start.alias("start"), (start + windows + words - 1).alias("stop"))

    # units of one row alone, and of the other classes of their anchors one unit that stands for its rows
    own = classes.where("low = high").select("h", "u")
    alone = candidates.join(own, ["h", "u"], "left_semi").select(
        "d", "place", "h", F.col("row").alias("low"), F.col("row").alias("high"), F.lit(True).alias("alone"))
    mixed = stash(own.select("h").distinct())
    others = classes.where("low < high").join(mixed, "h", "left_semi").select(
        "one.d", "one.place", "h", "low", "high", F.lit(False).alias("alone"))
    per_doc = alone.union(others).groupBy("d").agg(
        F.collect_list(F.struct("place", "h", "low", "high", "alone")).alias("wanted"))
    windowed = stash(texts.join(per_doc, "d").select("d", "text", "wanted").mapInArrow(
        lambda batches: _word_windows(batches, words),
        "h long, w long, d long, mark long, start long, low long, high long, alone boolean"))
    twice = stash(windowed.groupBy("h", "w").agg(F.min("low").alias("low"), F.max("high").alias("high")).where(
        "low < high").select("h", "w"))
    return whole.union(windowed.where("alone").join(twice, ["h", "w"], "left_semi").select(
        "d", "mark", "start", (F.col("start") + words).alias("stop")))


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order, within ``size``."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        stop = min(stop, size)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for start, stop in spans:
        kept.append(raw[at:start])
        at = stop
    return b"".join([*kept, raw[at:]])


def _own(raw: bytes, spans) -> list[tuple[int, int]]:
    mark = check(raw)
    return merged([(int(s["start"]), int(s["stop"])) for s in spans if s["mark"] == mark] if spans is not None else [],
                  len(raw))


def _cut_digest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, found in zip(texts, spans, strict=True):
        raw = text.encode()
        own = _own(raw, found)
        rows.append((len(raw), sum(b - a for a, b in own), len(own), hashlib.sha256(without(raw, own)).hexdigest()))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cut_bytes(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, found in zip(texts, spans, strict=True):
        raw = text.encode()
        own = _own(raw, found)
        rows.append(([{"start": a, "stop": b} for a, b in own], without(raw, own)))
    return pd.DataFrame(rows, columns=["spans", "kept"])


def cut_digest(text: str, found: str) -> Column:
    return F.pandas_udf(_cut_digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")(
        F.col(text), F.col(found))


def cut_bytes(text: str, found: str) -> Column:
    return F.pandas_udf(_cut_bytes, "spans array<struct<start:bigint,stop:bigint>>, kept binary")(
        F.col(text), F.col(found))


def _shared_words(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([sum(b - a for a, b in _own(text.encode(), found)) if found is not None else 0
                      for text, found in zip(texts, spans, strict=True)], dtype="int64")


def shared_words(text: str, found: str) -> Column:
    """How many words the spans of ``shared`` cover."""
    return F.pandas_udf(_shared_words, "long")(F.col(text), F.col(found))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    # a row's key: its id and text, so that ids may repeat or be null; with the mark 78 bits tell rows apart
    return plain.select("id", F.xxhash64("id", "text").alias("d"), "text")


def _by_row(spans: DataFrame, name: str) -> DataFrame:
    # rows that are equal in id and text have one key and the same spans
    return stash(spans.groupBy("d").agg(F.collect_set(F.struct("mark", "start", "stop")).alias(name)))


def shared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHARED) -> DataFrame:
    """(id, text, shared) for each row of ``docs``: like ``find``, the runs of ``words`` words that another row has too.

    Words are bounded by ASCII white space; spans count words. ``words`` is from
    WORD_ANCHOR to 518.
    """
    plain = _keyed(docs, id_col, text_col)
    return plain.join(_shared(plain, words), "d", "left").select("id", "text", "shared")


def _shared(plain: DataFrame, words: int) -> DataFrame:
    if not WORD_ANCHOR <= words <= WORD_ANCHOR + (1 << FIELD) - 2:
        raise ValueError(f"words must be from {WORD_ANCHOR} to {WORD_ANCHOR + (1 << FIELD) - 2}")
    with scope() as kept:
        per_doc = _by_row(shared_spans(plain.select("d", "text"), words), "shared")
        kept.append(per_doc)
    return per_doc


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         shard_units: int = SHARD_UNITS) -> DataFrame:
    """(id, text, found) for each row of ``docs``; a null text is empty.

    ``found`` is an array of (mark, start, stop), or null, and goes to
    ``cut_bytes`` or ``cut_digest`` with the text. Rows are documents of their own
    even if they share an id or have none; ``length`` is at most 575 bytes. An empty table gives an empty one. Other columns
    are not read.
    """
    if not ANCHOR <= length <= ANCHOR + (1 << FIELD) - 1:
        raise ValueError(f"length must be from {ANCHOR} to {ANCHOR + (1 << FIELD) - 1} bytes")
    plain = _keyed(docs, id_col, text_col)
    return plain.join(_found(plain, length, shard_units), "d", "left").select("id", "text", "found")


def _found(plain: DataFrame, length: int = LENGTH, shard_units: int = SHARD_UNITS) -> DataFrame:
    with scope() as kept:
        units = stash(ready(plain).where(F.octet_length("text") >= length).select("d", "text").mapInArrow(
            lambda batches: _units(batches, length), UNIT))
        # written first: a join of two plain shuffles is one that adaptive execution can split at a hot anchor
        often = stash(units.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
        candidates = stash(units.join(often, "h", "left_semi"))
        drop(units, often)
        per_doc = _by_row(repeated_spans(plain.select("d", "text"), candidates, length, shard_units), "found")
        kept.append(per_doc)
    return per_doc


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, spans, kept) of each row of ``docs``: its maximal removed runs and its remaining bytes."""
    found = find(docs, id_col, text_col, **options)
    return found.select(F.col("id").alias(id_col), cut_bytes("text", "found").alias("c")).select(id_col, "c.*")


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row; n_shared_words: its words in runs of SHARED that another row has too."""
    plain = _keyed(docs, "doc_id", "text")
    both = plain.join(_found(plain), "d", "left").join(_shared(plain, SHARED), "d", "left")
    return both.select(F.col("id").alias("doc_id"), cut_digest("text", "found").alias("c"),
                       shared_words("text", "shared").alias("n_shared_words")).select("doc_id", "c.*", "n_shared_words")
