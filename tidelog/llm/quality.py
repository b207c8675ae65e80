"""Document quality by hierarchical empirical Bayes.

Three levels of evidence on one logit scale: the text itself (a logistic
regression on shape features, fitted on all labelled rows), the path it lies
in, and the site the path belongs to. Site and path rates are Beta posteriors
from grouped sums: a path shrinks toward its site and a site toward the whole,
the more the fewer documents it has; how strongly is estimated from the spread
of the rates themselves (method of moments). A document's own evidence is taken
out of its path and its site before they speak about it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import ready, stash

NAMES = ("log_words", "word_length", "distinct", "repeated", "top_word", "upper", "digits", "marks", "shouts", "bars",
         "oddities", "line_length")
FLOOR = 0.02
STRENGTH = (1.0, 10_000.0)


def shape(text: str | None) -> list[float]:
    """Shape features of a whole text, each bounded; zeros for a text without words."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    n = len(words)
    counts = Counter(words)
    raw = text.encode()
    size = len(raw)
    kinds = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    letters = max(1, int(kinds[65:91].sum() + kinds[97:123].sum()))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))

    def rate(chars: str) -> float:
        return float(kinds[[ord(c) for c in chars]].sum()) / n

    return [math.log1p(n), min(20.0, (size - n) / n), len(counts) / n ** 0.8 if n > 1 else 1.0, same / n,
            max(counts.values()) / n, float(kinds[65:91].sum()) / letters, float(kinds[48:58].sum()) / size,
            rate(".,;:"), min(4.0, rate("!")), min(4.0, rate("|")), min(4.0, rate("#$%&*<>{}[]=_~^\\")),
            math.log1p(size / (1 + int(kinds[10])))]


def _shapes(texts: pd.Series) -> pd.Series:
    return pd.Series([shape(t) for t in texts])


def shapes(text: str) -> Column:
    return F.pandas_udf(_shapes, "array<double>")(F.col(text))


def fit(shaped: DataFrame, labels: DataFrame, id_col: str = "doc_id",
        label_col: str = "quality") -> tuple[list[float], float, float]:
    """(weights, intercept, share of good labels) over all labelled rows of ``shaped`` (id, shape).

    Null labels and labels without a document count for nothing. Where the labels
    of one id contradict each other the more frequent holds, a tie counts as bad.
    With no labels, or with one kind only, the text gives no evidence: zero weights.
    """
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where(
        "id is not null and label is not null").groupBy("id").agg((F.avg("label") > 0.5).cast("double").alias("label"))
    rows = stash(shaped.select("id", "shape").join(told, "id").select("label", "shape"))
    n, good = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or good in (0, n):
        return [0.0] * len(NAMES), 0.0, 0.5
    model = LogisticRegression(maxIter=40, regParam=1e-3, standardization=True).fit(
        rows.select("label", array_to_vector("shape").alias("features")))
    return [float(w) for w in model.coefficients], float(model.intercept), good / n


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior weight, in documents, from how far group rates spread beyond their sampling noise around ``mean``."""
    noise, spread, level = groups.agg(
        F.sum(mean * (1 - mean)), F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2),
        F.sum(F.col("n") * mean * (1 - mean))).first()
    total, squares = groups.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    if not total:
        return STRENGTH[0]
    between = (spread - noise) / max(1e-9, total - squares / total)
    if between <= 0:
        return STRENGTH[1]
    return float(min(max(level / total / between - 1, STRENGTH[0]), STRENGTH[1]))


def _described(docs: DataFrame, site: Column, path: Column, text_col: str, prefix: str) -> DataFrame:
    return ready(docs).withColumns({
        f"{prefix}shape": shapes(text_col), f"{prefix}site": F.coalesce(site.cast("string"), F.lit("\0")),
        f"{prefix}path": F.coalesce(path.cast("string"), F.lit("\0"))})


def learn(docs: DataFrame, labels: DataFrame, site: Column, path: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> tuple[DataFrame, Callable[[DataFrame, str], DataFrame]]:
    """(id, shape, site, path of each row; a function that judges rows that have these columns under a prefix).

    The texts are read once. Beyond that, only shapes and grouped sums move.
    """
    described = _described(docs.select(id_col, text_col, site.alias("_site"), path.alias("_path")), F.col("_site"),
                           F.col("_path"), text_col, "_q_")
    shaped = stash(described.select(F.col(id_col).alias("id"), *[F.col(f"_q_{c}").alias(c) for c in ("shape", "site", "path")]))
    weights, intercept, share = fit(shaped, labels, id_col, label_col)

    def evidence(shape: str) -> Column:
        linear = F.lit(intercept)
        for i, weight in enumerate(weights):
            linear = linear + F.lit(weight) * F.col(shape)[i]
        return 1 / (1 + F.exp(-linear))

    paths = stash(shaped.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum(evidence("shape")).alias("s")))
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total, good = sites.agg(F.sum("n"), F.sum("s")).first()
    overall = min(max(good / total, FLOOR), 1 - FLOOR) if total else 0.5
    weight = _strength(sites, F.lit(overall))
    sites = sites.select("site", F.col("n").alias("site_n"), F.col("s").alias("site_s"))
    groups = stash(paths.join(sites, "site"))
    inner = _strength(groups, (F.col("site_s") + weight * overall) / (F.col("site_n") + weight))

    def judged(rows: DataFrame, prefix: str) -> DataFrame:
        own, n, s, site_n, site_s = (F.col(f"{prefix}{c}") for c in ("evidence", "n", "s", "site_n", "site_s"))
        site_rate = (site_s - own + weight * overall) / (site_n - 1 + weight)
        rate = (s - own + inner * site_rate) / (n - 1 + inner)
        bounded = F.least(F.greatest(rate, F.lit(FLOOR)), F.lit(1 - FLOOR))
        told = F.least(F.greatest(own, F.lit(1e-9)), F.lit(1 - 1e-9))
        posterior = _logit(told) - math.log(share / (1 - share)) + _logit(bounded)
        sums = groups.select(*[F.col(c).alias(f"{prefix}{c}") for c in groups.columns])
        return rows.withColumn(f"{prefix}evidence", evidence(f"{prefix}shape")).join(
            sums, [f"{prefix}site", f"{prefix}path"], "left").withColumns({
                f"{prefix}site_rate": site_rate, f"{prefix}path_rate": bounded, f"{prefix}quality": 1 / (1 + F.exp(-posterior))}).drop(
            *[f"{prefix}{c}" for c in ("n", "s", "site_n", "site_s", "shape")])

    return shaped, judged


def judge(docs: DataFrame, labels: DataFrame, site: Column, path: Column, prefix: str = "_q_", text_col: str = "text",
          **options) -> DataFrame:
    """``docs`` with columns evidence, site_rate, path_rate, quality (and site, path), named with ``prefix``.

    ``quality`` is the posterior probability that the document is good. No column
    of ``docs`` may start with ``prefix``. Null sites and paths are groups of
    their own. An empty table stays empty. Rows are neither lost nor repeated,
    whatever their ids.
    """
    _, judged = learn(docs, labels, site, path, text_col=text_col, **options)
    return judged(_described(docs, site, path, text_col, prefix), prefix)


def keep_good(docs: DataFrame, labels: DataFrame, site: Column, path: Column, threshold: float = 0.5,
              **options) -> DataFrame:
    """The rows of ``docs`` whose posterior reaches ``threshold``; columns as they were."""
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    judged = judge(docs, labels, site, path, prefix=prefix, **options)
    return judged.where(F.col(f"{prefix}quality") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, evidence, site_rate, path_rate, quality, kept; the site is the source, the path its language section."""
    shaped, judged = learn(docs.select("doc_id", "text", "source", "lang"), labels, F.col("source"), F.col("lang"))
    rows = judged(shaped, "")
    return rows.select(F.col("id").alias("doc_id"), *[F.round(c, 9).alias(c) for c in (
        "evidence", "site_rate", "path_rate", "quality")], (F.col("quality") >= 0.5).alias("kept"))
