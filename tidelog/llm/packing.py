"""Packing by shortest-pack-first over the length histogram.

Documents are tokenised where they lie and cut into pieces of ``capacity``
tokens and a rest. Only the histogram of piece lengths (at most ``capacity``
numbers) reaches the driver. There, lengths are placed longest first, each into
the open packs that hold least so far; the state is a count for each distinct
packing pattern, not a list of packs. A length splits at most one pattern and
opens at most two, so there are at most ``3 * capacity`` patterns with fewer
than ``sqrt(2 * capacity)`` distinct lengths each, whatever the input: the table
of pattern slots is broadcast under that bound. Pieces find their slot by their
rank among the pieces of their length; ranks are counted in slices, so a length
that holds a third of all pieces spreads over many tasks.
"""

from __future__ import annotations

import base64
import os
import zlib
from array import array
from collections import Counter
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import ready, stash

CAPACITY = 2048
END_ID = 1
SLICE_ROWS = 4096
CACHED_WORDS = 300_000
VOCABULARY = "byte_bpe_50k"
PIECES = "array<struct<start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint>>"


class WordTokenizer:
    """Byte-level BPE that remembers words.

    A single blank between two other characters always starts a pre-token, so a
    text without other runs of white space is the concatenation of its
    blank-led words; their ids are kept as little-endian bytes. Other texts go
    through the library whole.
    """

    def __init__(self, vocabulary: str):
        import re

        import public_tokenizers
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                     special_tokens={})
        self.json = public_tokenizers.path(f"{vocabulary}.json")
        self.special = None
        self.piece = self.bpe._core_bpe.encode_single_piece
        self.pairs = [pair for other in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f" for pair in (" " + other, other + " ")] + ["  "]
        self.rare = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        self.words: dict[str, bytes] = {}
        self.line_end = self._plain("\n")
        self.marks = {mark: self._plain(mark) for mark in ".,"}

    def _by_library(self, text: str) -> bytes:
        """The library whose strings for special tokens count as those tokens."""
        if self.special is None:
            from tokenizers import Tokenizer

            self.special = Tokenizer.from_file(self.json)
        return np.array(self.special.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def _led(self, word: str) -> bytes:
        """Ids of a blank and ``word``, which starts and ends a pre-token; a sentence end is put together."""
        head, line_end, tail = word.partition("\n")
        if line_end and head and tail and not head[-1].isspace() and not tail[0].isspace():
            return (self.words.get(head) or self._led(head)) + self.line_end + self._plain(tail)
        if word[-1] in self.marks and word[:-1].isalpha():
            ids = (self.words.get(word[:-1]) or self._led(word[:-1])) + self.marks[word[-1]]
        elif word.isalpha():
            ids = array("I", self.piece(b" " + word.encode())).tobytes()
        else:
            return self._plain(" " + word)
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        self.words[word] = ids
        return ids

    def _even(self, text: str) -> bool:
        """Whether no blank stands beside other white space."""
        return not (any(pair in text for pair in self.pairs) or text[:1] == " " or text[-1:] == " "
                    or not text.isascii() and self.rare.search(text))

    def ids(self, text: str) -> bytes:
        """The ids of ``text`` as unsigned little-endian 32-bit numbers."""
        if "<|" in text and "<|endoftext|>" in text:
            return self._by_library(text)
        head, *words = text.split(" ")
        if not self._even(text):
            # cut at the even blanks only: a run of white space stays with the words around it
            parts, run = [], head
            for word in words:
                if run and word and not run[-1].isspace() and not word[0].isspace():
                    parts.append(run)
                    run = " " + word
                else:
                    run += " " + word
            return b"".join([self._plain(part) for part in [*parts, run]])
        known, make = self.words.get, self._led
        return (self._plain(head) if head else b"") + b"".join([known(word) or make(word) for word in words])


@cache
def tokenizer(vocabulary: str) -> WordTokenizer:
    return WordTokenizer(vocabulary)


def document_pieces(text: str | None, vocabulary: str = VOCABULARY, capacity: int = CAPACITY,
                    end_id: int = END_ID) -> list[tuple[int, int, int, int]]:
    """(start, length, crc32 of the ids, tokens of the document) of each piece, in order."""
    ids = tokenizer(vocabulary).ids(text or "") + end_id.to_bytes(4, "little")
    total = len(ids) // 4
    return [(at, min(capacity, total - at), zlib.crc32(ids[4 * at:4 * (at + capacity)]), total)
            for at in range(0, total, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
           capacity: int = CAPACITY) -> DataFrame:
    @F.pandas_udf(PIECES)
    def cut(texts: pd.Series) -> pd.Series:
        names = ("start", "length", "ids_crc32", "doc_tokens")
        return pd.Series([[dict(zip(names, p, strict=True)) for p in document_pieces(t, vocabulary, capacity)]
                          for t in texts])

    return ready(docs).select(F.col(id_col).alias("doc_id"), F.explode(cut(F.col(text_col))).alias("p")).select(
        "doc_id", "p.*")


Pattern = tuple[int, dict[int, int]]


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Length -> count, packed: (number of packs, {length: copies in the pack, longest first}) for each pattern.

    Shortest pack first: a length goes to the packs with most room left, and
    opens new ones only when no pack has room for it.
    """
    by_room: dict[int, list[Pattern]] = {}

    def put(packs: int, items: dict[int, int]) -> None:
        room = capacity - sum(length * copies for length, copies in items.items())
        by_room.setdefault(room, []).append((packs, items))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(by_room, default=0)
            if room < length:
                fit = capacity // length
                if left >= fit:
                    put(left // fit, {length: fit})
                if left % fit:
                    put(1, {length: left % fit})
                break
            packs, items = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            used = min(packs, left)
            if used < packs:
                put(packs - used, items)
            put(used, items | {length: items.get(length, 0) + 1})
            left -= used
    return [pattern for room in sorted(by_room) for pattern in by_room[room]]


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, copies, first sequence, offset) for each length of each pattern."""
    taken: Counter[int] = Counter()
    rows, sequence = [], 0
    for packs, items in patterns:
        offset = 0
        for length, copies in items.items():
            rows.append((length, taken[length], taken[length] + packs * copies, copies, sequence, offset))
            taken[length] += packs * copies
            offset += length * copies
        sequence += packs
    return rows


def _ranked(cut: DataFrame, slices: int) -> DataFrame:
    """Pieces with their rank (from 0) among the pieces of their length."""
    order: list[Column] = [F.col(c) for c in ("doc_id", "start", "ids_crc32", "doc_tokens")]
    sliced = cut.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "start"), F.lit(slices)))
    sizes = sliced.groupBy("length", "_slice").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    inside = sliced.withColumn("_at", F.row_number().over(Window.partitionBy("length", "_slice").orderBy(*order)))
    return inside.join(bases, ["length", "_slice"]).withColumn("rank", F.col("_at") - 1 + F.col("_base")).drop(
        "_slice", "_at", "_base")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
         capacity: int = CAPACITY, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document ends with one end token, so an empty or null text is one
    piece of one token. Repeated rows are packed as often as they occur. An
    empty table gives no piece. Other columns of ``docs`` are not read.
    """
    cut = stash(pieces(docs, id_col, text_col, vocabulary, capacity))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(pack_histogram(histogram, capacity))
    schema = "length long, first long, after long, copies long, sequence long, place long"
    places = F.broadcast(docs.sparkSession.createDataFrame(table, schema))
    slices = max(1, -(-max(histogram.values(), default=0) // slice_rows))
    ranked = _ranked(cut, slices)
    at = F.col("rank") - F.col("first")
    return ranked.join(places, "length").where("rank >= first and rank < after").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("place") + F.col("length") * F.pmod(at, F.col("copies"))).alias("offset"))


def op3(docs: DataFrame) -> DataFrame:
    return pack(docs)
