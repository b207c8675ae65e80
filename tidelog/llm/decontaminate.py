"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ by k = ``rate`` * m edits. Cut into k + 1
pieces, at least one piece of any such copy is untouched. All pieces of a block
of items stand in one Aho-Corasick automaton; every document is read once
against it, and where a piece is found the window around its diagonal is
verified with Myers' bit-parallel distance. The verification grows with the
evidence: j neighbouring pieces may hold j - 1 edits, and in any copy some piece
has ancestors that all keep to that, so pairs, fours, eights ... of pieces are
checked before the whole item, and chance hits end after a few characters. An
item is verified whole, whatever its length; one too short for edits is searched
as it is, between word ends. Items come in blocks of bounded size, one pass over
the documents each, so a large benchmark does not grow what a task holds; what
the passes find meets the documents by the hash of the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import free_name, ready, scope, stash, text_of

RATE = 0.1
LEAST_CHARS = 16
BLOCK_CHARS = 2_000_000
WORDS = re.compile(r"[^\W_]+")

Unit = tuple[int, str, int]


def normal(text: str | None) -> str:
    """Lower case, letters and digits, single blanks."""
    return " ".join(WORDS.findall((text or "").lower()))


def units(item: int, text: str | None, rate: float = RATE) -> list[Unit]:
    """(item, normalised text, error budget), if the item has a letter or digit; below LEAST_CHARS the budget is zero."""
    plain = normal(text)
    if not plain:
        return []
    return [(item, plain, int(rate * len(plain)) if len(plain) >= LEAST_CHARS else 0)]


def budget_pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """(start, end) of budget + 1 pieces of nearly equal length."""
    bounds = [length * i // (budget + 1) for i in range(budget + 2)]
    return list(zip(bounds, bounds[1:], strict=False))


def ancestors(pieces: int) -> list[list[tuple[int, int]]]:
    """For each piece the runs of pieces (first, after the last) above it in a halving tree, the smallest first."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(pieces)]
    open_runs = [(0, pieces)]
    while open_runs:
        low, high = open_runs.pop()
        if high - low > 1:
            for i in range(low, high):
                out[i].insert(0, (low, high))
            middle = (low + high) // 2
            open_runs += [(low, middle), (middle, high)]
    return out


def char_masks(text: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, char in enumerate(text):
        masks[char] = masks.get(char, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], length: int, text: str, budget: int, first: bool = False) -> int | None:
    """Least edit distance of the pattern to any part of ``text``, if within ``budget``; with ``first``, any such one."""
    full, high = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, best = full, 0, length, None
    for char in text:
        equal = masks.get(char, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1, down << 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical
        if score <= budget and (best is None or score < best):
            best = score
            if first:
                break
    return best


class Finder:
    """One block of units: their pieces in an automaton, their character masks for the verification."""

    def __init__(self, block: list[Unit]):
        import ahocorasick

        self.block, self.masks = block, {}
        self.bounds = [budget_pieces(len(text), budget) for _, text, budget in block]
        self.above = {n: ancestors(n) for n in {len(b) for b in self.bounds}}
        held: dict[str, list[tuple[int, int]]] = {}
        for u, (_, text, _) in enumerate(block):
            for i, (start, end) in enumerate(self.bounds[u]):
                held.setdefault(text[start:end], []).append((u, i))
        self.automaton = ahocorasick.Automaton()
        for piece, places in held.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def _distance(self, u: int, low: int, high: int, plain: str, at: int, slack: int, first: bool) -> int | None:
        """Pieces low to high of unit u against the text around ``at``, within one edit less than their number."""
        bounds = self.bounds[u]
        start, end = bounds[low][0], bounds[high - 1][1]
        part = self.block[u][1][start:end]
        window = plain[max(0, at - slack):max(0, at + len(part) + slack)]
        if part in window:
            return 0
        masks = self.masks.get((u, low, high))
        if masks is None:
            masks = self.masks[u, low, high] = char_masks(part)
        return myers(masks, len(part), window, high - low - 1, first)

    def find(self, text: str | None) -> dict[int, int]:
        """Item -> least distance of it to any part of the document, where that is within its budget."""
        plain = normal(text)
        found: dict[int, int] = {}
        tried: dict[int, list[tuple[int, int]]] = {}
        for last, (size, places) in self.automaton.iter(plain):
            for u, i in places:
                item, unit, budget = self.block[u]
                bounds = self.bounds[u]
                start = last + 1 - size - bounds[i][0]
                if len(unit) < LEAST_CHARS:  # as it is, between word ends
                    if plain[start - 1:start] in ("", " ") and plain[last + 1:last + 2] in ("", " "):
                        found[item] = 0
                    continue
                if found.get(item) == 0 or any(low <= start <= high for low, high in tried.get(u, ())):
                    continue
                runs = self.above[len(bounds)][i]
                if any(self._distance(u, low, high, plain, start + bounds[low][0], high - low - 1, True) is None
                       for low, high in runs[:-1]):
                    continue
                # diagonals within the budget on either side are verified by one wider window
                tried.setdefault(u, []).append((start - budget, start + budget))
                distance = self._distance(u, 0, len(bounds), plain, start, 2 * budget, False)
                if distance is not None and distance < found.get(item, budget + 1):
                    found[item] = distance
        return found


_FINDERS: dict[str, Finder] = {}


def finder_of(shared) -> Finder:
    """The block's finder, built once in each Python worker."""
    block = shared.value
    held = _FINDERS.get("now")
    if held is None or held.block is not block:
        held = _FINDERS["now"] = Finder(block)
    return held


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", rate: float = RATE,
           block_chars: int = BLOCK_CHARS) -> Iterator[list[Unit]]:
    """The items, in blocks of about ``block_chars`` characters, each small enough to broadcast; one at a time is held."""
    items = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    count = max(1, -(-int(size) // block_chars))
    for b in range(count):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == b).collect()
        block = [unit for row in sorted(rows, key=lambda r: (r["i"], r["t"])) for unit in units(row["i"], row["t"], rate)]
        if block or count == 1:
            yield block


LEAKS = "array<struct<item_id:bigint,distance:bigint>>"


def _search(shared):
    @F.pandas_udf(LEAKS)
    def search(texts: pd.Series) -> pd.Series:
        finder = finder_of(shared)
        return pd.Series([[{"item_id": i, "distance": d} for i, d in sorted(finder.find(t).items())] for t in texts])

    return search


def _pass(texts: DataFrame, block: list[Unit]) -> DataFrame:
    """(print, item_id, distance), written: what one block of items finds, once for each different text."""
    shared = texts.sparkSession.sparkContext.broadcast(block)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = finder_of(shared)
        for batch in batches:
            rows = [(hashlib.md5(t.encode()).hexdigest(), i, d) for t in batch.column(0).to_pylist() for i, d in finder.find(t).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(
                (pa.string(), pa.int64(), pa.int64()))], ["print", "item_id", "distance"])

    out = stash(texts.mapInArrow(searched, "print string, item_id long, distance long").distinct())
    shared.unpersist()
    return out


def leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS,
          out: str = "leaks") -> DataFrame:
    """``docs`` with the column ``out``: array of (item_id, distance), by item, of the items found in each text.

    Null or empty texts hold no item. Null items, and items without a letter or
    digit, are no evidence. Items shorter than LEAST_CHARS once normalised must
    stand as they are, between word ends. Repeated items and rows each give
    their own result. All columns of ``docs`` stay; a column named like ``out``
    is replaced. A benchmark of one block is searched where the documents lie;
    several blocks take a pass each.
    """
    docs, parts = ready(docs), blocks(items, item_id, item_text, rate, block_chars)
    block, more = next(parts, []), next(parts, None)
    if more is None:
        found = _search(docs.sparkSession.sparkContext.broadcast(block))(F.col(text_col))
        return docs.withColumn(out, F.array_sort(found))
    texts = docs.select(text_of(text_col).alias("text"))
    with scope() as kept:
        hits = _pass(texts, block).union(_pass(texts, more))
        for block in parts:
            hits = hits.union(_pass(texts, block))
        hits = stash(hits.groupBy("print", "item_id").agg(F.min("distance").alias("distance")).groupBy("print").agg(
            F.array_sort(F.collect_list(F.struct("item_id", "distance"))).alias("found")))
        kept.append(hits)
    name, found = free_name(docs, "print"), free_name(docs, "found")
    hits = hits.select(F.col("print").alias(name), F.col("found").alias(found))
    joined = docs.withColumn(name, F.md5(text_of(text_col))).join(hits, name, "left")
    leaked = joined.withColumn(out, F.coalesce(F.col(found), F.array().cast(LEAKS)))
    return leaked.select(*[F.col(f"`{c}`") for c in docs.withColumn(out, F.lit(0)).columns])


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds an item; all columns as they were."""
    scratch = free_name(docs, "leaks")
    return leaks(docs, items, text_col, out=scratch, **options).where(F.size(scratch) == 0).drop(scratch)


def op1(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, n_items, item_ids, distances (comma-joined, by item)."""
    return leaks(docs.select("doc_id", "text"), items).select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"),
        F.col("leaks.item_id").alias("item_ids"), F.col("leaks.distance").alias("distances"))
