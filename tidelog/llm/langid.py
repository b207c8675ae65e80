"""Language identification by words first, then shorter and shorter character n-grams.

Training counts words and character n-grams for each language on a sample of
at most about ``sample_docs`` documents a language (a documented bound, drawn by
hash). Each word of a text is looked up as a whole; a word no language knows is
read as n-grams, at each place the longest that is known, down to single
letters. Scores are log frequencies; a text's language has the largest sum.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import ready, stash

SAMPLE_DOCS = 2000
WORDS_KEPT = 20_000
GRAMS_KEPT = 20_000
LONGEST = 4
LETTERS = re.compile(r"[^\W\d_]+")
REMEMBERED = 100_000
UNKNOWN = "und"


def words_of(text: str | None) -> Counter[str]:
    return Counter(LETTERS.findall((text or "").lower()))


def grams_of(word: str, size: int) -> list[str]:
    marked = f"<{word}>" if size > 1 else word
    return [marked[i:i + size] for i in range(len(marked) - size + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, size, token, n); size 0 is a word, others n-grams."""
    for batch in batches:
        sums: Counter[tuple[str, int, str]] = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word, n in words_of(text).items():
                sums[lang, 0, word] += n
                for size in range(1, LONGEST + 1):
                    for gram in grams_of(word, size):
                        sums[lang, size, gram] += n
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
            pa.array([k[2] for k in keys], pa.string()), pa.array(list(sums.values()), pa.int64())],
            ["lang", "size", "token", "n"])


class Model:
    """Log frequencies of words and n-grams for each language."""

    def __init__(self, langs: list[str], rows: list[tuple[str, int, str, int]]):
        self.langs = langs
        place = {lang: i for i, lang in enumerate(langs)}
        totals = np.ones((LONGEST + 1, len(langs)))
        kinds = Counter({(r[1], r[2]): 0 for r in rows})
        for lang, size, _, n in rows:
            totals[size, place[lang]] += n
        sizes = Counter(size for size, _ in kinds)
        floor = np.array([[math.log(0.5 / (totals[s, i] + 0.5 * sizes[s] + 1)) for i in range(len(langs))]
                          for s in range(LONGEST + 1)])
        self.tables: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
        for lang, size, token, n in rows:
            row = self.tables[size].setdefault(token, floor[size].copy())
            i = place[lang]
            row[i] = math.log((n + 0.5) / (totals[size, i] + 0.5 * sizes[size] + 1))
        self.seen: dict[str, np.ndarray] = {}

    def word(self, word: str) -> np.ndarray:
        """Score of a word in each language, centred."""
        known = self.tables[0].get(word)
        if known is None:
            known = self.seen.get(word)
            if known is None:
                known = self._backed_off(word)
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[word] = known
        return known

    def _backed_off(self, word: str) -> np.ndarray:
        marked = f"<{word}>"
        total, parts = np.zeros(len(self.langs)), 0
        for at in range(len(marked) - 1):
            for size in range(min(LONGEST, len(marked) - at), 0, -1):
                row = self.tables[size].get(marked[at:at + size])
                if row is not None:
                    total += row
                    parts += 1
                    break
        return total / math.sqrt(parts) if parts else total

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = words_of(text)
        if not self.langs or not any(c.isalpha() for word in counts for c in word):
            return UNKNOWN, 0.0
        scores = np.array([self.word(w) for w in counts])
        scores = scores - scores.max(axis=1, keepdims=True)
        weights = np.fromiter(counts.values(), dtype=float, count=len(counts))
        total = weights @ scores / max(1.0, weights.sum() / 20)
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model of the rows of ``docs`` that are ``usable`` and whose text and language are not null.

    At most about ``sample_docs`` documents of each language, drawn by a hash of
    the id. The most frequent words and n-grams are kept, ties by code point, so
    the model is bounded. Languages without a word are not learned.
    """
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(lang_col).count().collect()
    if not sizes:
        return Model([], [])
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r[lang_col], min(1.0, sample_docs / r["count"]))])
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1_000_000)) < F.lit(1_000_000) * share[F.col(lang_col)]
    counts = ready(rows).where(drawn).select(lang_col, text_col).mapInArrow(
        _count, "lang string, size int, token string, n long").groupBy("lang", "size", "token").agg(F.sum("n").alias("n"))
    ranked = stash(counts).withColumn("at", F.row_number().over(
        Window.partitionBy("lang", "size").orderBy(F.desc("n"), "token")))
    kept = ranked.where(F.col("at") <= F.when(F.col("size") == 0, WORDS_KEPT).otherwise(GRAMS_KEPT))
    table = [(r["lang"], r["size"], r["token"], r["n"]) for r in kept.drop("at").toLocalIterator()]
    table.sort()
    return Model(sorted({r[0] for r in table}), table)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Struct (lang_pred, score) of the text of each row; ``und`` and 0 for null texts and texts without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    ready(docs)
    return predict(F.col(text_col))


def op4(docs: DataFrame) -> DataFrame:
    """Fold 2 of crc32(doc_id) is held out from training; every document gets a prediction."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2
    model = train(docs, ~held)
    return docs.select("doc_id", held.alias("held_out"), identify(docs, model).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")
