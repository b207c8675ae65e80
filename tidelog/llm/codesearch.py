"""Exact top-k in Hamming space by incremental multi-index hashing.

Vectors become binary codes: the sign of each component. Equal codes are one
row of the index, with the least ids that any answer can need. A code is cut
into segments. A query first asks every segment for its own value, then for
the values one bit farther away than before: one segment at a time, or all
together where that takes few probes. A code that
no segment met differs by more than its radius in each, so after every step the
sum of (radius + 1) over the segments, less one, is a distance within which
nothing is missing: once the k-th verified distance is that near, the query
leaves. At full radius everything has been met, so every query ends. Where the
flips of a step outnumber the values that a segment has, the values are
compared instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import scope, stash

#: What a probe costs, against comparing a code that it meets.
PROBE = 4.0
#: Segments grow together while their probes of one radius are at most this many.
FEW = 512


def code_of(vector: Column, bits: int) -> Column:
    """Signs of the first ``bits`` components as array<long> of 32-bit words; a missing component counts as negative."""
    words = []
    for at in range(0, bits, 32):
        word = F.lit(0).cast("long")
        for i in range(at, min(bits, at + 32)):
            word = word + F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << (i - at)).cast("long")).otherwise(F.lit(0).cast("long"))
        words.append(word)
    return F.array(*words)


def kth_distance(bits: int, codes: int, k: int) -> int:
    """About how far the k-th of ``codes`` random codes is."""
    within, d = math.comb(bits, 0), 0
    while codes * within < (k + 1) * 2 ** bits and d < bits:
        d += 1
        within += math.comb(bits, d)
    return d


def cut(bits: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments, ``parts`` of them in each 32-bit word."""
    out = []
    for at in range(0, bits, 32):
        size = min(32, bits - at)
        own = min(parts, size)
        bounds = [size * i // own for i in range(own + 1)]
        out += [(at + a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]
    return out


def steps(parts: list[tuple[int, int]]) -> Iterator[tuple[int, list[int], int]]:
    """(radius, segments that grow to it, distance within which nothing is missing then)."""
    sizes = [size for _, size in parts]
    for radius in range(max(sizes) + 1):
        growing = [j for j, size in enumerate(sizes) if radius <= size]
        together = sum(math.comb(sizes[j], radius) for j in growing) <= FEW
        for turn in [growing] if together else [[j] for j in growing]:
            grown = [min(radius if i <= turn[-1] else radius - 1, n) for i, n in enumerate(sizes)]
            # a segment at its full size has shown all its values, and with it all codes
            yield radius, turn, sum(sizes) if any(r == n for r, n in zip(grown, sizes, strict=True)) else sum(r + 1 for r in grown) - 1


def segments(bits: int, codes: int, k: int = 10) -> list[tuple[int, int]]:
    """The cut with the least expected work for one query: its probes, dealt out one by one, and the codes they meet."""
    far = kth_distance(bits, codes, k)

    def work(parts: list[tuple[int, int]]) -> float:
        total = 0.0
        for radius, grown, reach in steps(parts):
            for j in grown:
                probes = min(math.comb(parts[j][1], radius), codes)
                total += PROBE * probes + codes * math.comb(parts[j][1], radius) / 2 ** parts[j][1]
            if reach >= far:
                break
        return total

    return min((cut(bits, n) for n in range(2, 9)), key=work)


def _segment(code: Column, first: int, size: int) -> Column:
    return F.shiftright(code[first // 32], first % 32).bitwiseAND(F.lit((1 << size) - 1)).cast("int")


def _distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def _first(rows: DataFrame, keys: list[str], order: list[Column], count: int) -> DataFrame:
    """At most ``count`` rows of each key; Spark cuts each task's rows before the shuffle."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
        F.col("_at") <= count).drop("_at")


def _probes(radius: int, size: int, values: DataFrame) -> Column:
    """The values of a segment ``radius`` bits from ``value``; ``values`` has all that the segment holds, a row each."""
    flips = math.comb(size, radius)
    if values.limit(flips).count() < flips:
        known = F.lit([r[0] for r in values.collect()] or [-1])
        return F.filter(known, lambda v: F.bit_count(v.bitwiseXOR(F.col("value"))) == radius)
    return F.transform(F.lit([x for x in range(1 << size) if x.bit_count() == radius]), lambda x: x.bitwiseXOR(F.col("value")))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, id_col: str = "vec_id",
          vector_col: str = "embedding", parts: list[tuple[int, int]] | None = None) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest other ids by code, ties by smaller id.

    ``queries`` are rows of the same form; an id is no neighbour of itself. Rows
    with a null id or a null vector are neither indexed nor asked; missing
    components count as negative. An id with several codes is as near as the
    nearest of them, and asks with each. Fewer than k other ids give fewer
    neighbours; an empty table, or no query, gives none. Other columns are not
    read.
    """
    with scope() as kept:
        answers = _answers(rows, queries, k, bits, id_col, vector_col, parts)
        kept.append(answers)
    return answers


def _answers(rows: DataFrame, queries: DataFrame, k: int, bits: int, id_col: str, vector_col: str,
             parts: list[tuple[int, int]] | None) -> DataFrame:
    def coded(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(
            F.col(id_col).alias("id"), code_of(F.col(vector_col), bits).alias("code")).distinct()

    # up to k ids of a code may stand in an answer already through nearer codes, and as many again are needed
    members = stash(_first(coded(rows), ["code"], [F.col("id")], 2 * k + 2))
    index = stash(members.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = stash(coded(queries))
    wanted = min(k + 1, rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(id_col).distinct().limit(k + 1).count())
    parts = parts or segments(bits, index.count(), k)

    def dealt(code: Column, chosen: list[int]) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(j).alias("segment"), _segment(code, *parts[j]).alias("value")) for j in chosen]))

    table = stash(index.select(dealt(F.col("code"), list(range(len(parts)))).alias("s"), "code", "ids").select("s.*", "code", "ids"))
    # worst: no code farther than this can be in the answer any more
    open_queries = stash(asked.select(F.col("code").alias("query")).distinct().withColumn("worst", F.lit(bits)))
    held, done = None, []
    for radius, grown, reach in steps(parts):
        own = open_queries.select("query", "worst", dealt(F.col("query"), grown).alias("s")).select("query", "worst", "s.*")
        probes = own if not radius else None
        for size in sorted({parts[j][1] for j in grown}) if radius else []:
            alike = [j for j in grown if parts[j][1] == size]
            near = _probes(radius, size, table.where(F.col("segment").isin(alike)).select("value").distinct())
            more = own.where(F.col("segment").isin(alike)).select("query", "worst", "segment", F.explode(near).alias("value"))
            probes = more if probes is None else probes.union(more)
        # the probes are many times their queries: never a side to broadcast
        own = table.where(F.col("segment").isin(grown))
        met = probes.hint("merge").join(own, (probes["segment"] == own["segment"]) & (probes["value"] == own["value"]) & (
            _distance("query", "code") <= F.col("worst")))
        fresh = met.select("query", F.explode("ids").alias("id"), _distance("query", "code").alias("distance"))
        if held is not None:
            fresh = fresh.union(held)
        fresh = fresh.groupBy("query", "id").agg(F.min("distance").alias("distance"))
        best = stash(_first(fresh, ["query"], [F.col("distance"), F.col("id")], k + 1))
        state = best.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        full = F.coalesce(F.col("n") >= wanted, F.lit(False))
        state = stash(open_queries.join(state, "query", "left").select(
            "query", F.when(full, F.col("far")).otherwise(F.lit(bits)).alias("worst"),
            (full & (F.col("far") <= reach) | F.lit(reach >= bits)).alias("over")))
        done.append(best.join(state.where("over").select("query"), "query", "left_semi"))
        held = best.join(state.where("not over").select("query"), "query", "left_semi")
        open_queries = state.where("not over").select("query", "worst")
        if not open_queries.limit(1).count():
            break
    answers = done[0]
    for more in done[1:]:
        answers = answers.union(more)
    named = asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(answers, "query").where("id <> query_id")
    nearest = named.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return stash(nearest.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("neighbor_id"),
        F.col("distance").cast("long").alias("distance")))


def op8(vectors: DataFrame) -> DataFrame:
    """Every row whose id is divisible by 100 asks for its 10 nearest codes among all rows."""
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL = """
with coded as (
  select vec_id, [x > 0 for x in embedding] as code from embeddings
  where vec_id is not null and embedding is not null),
pairs as (
  select q.vec_id as query_id, n.vec_id as neighbor_id,
    cast(len([i for i in range(1, 65) if q.code[i] <> n.code[i]]) as bigint) as distance
  from coded q join coded n on q.vec_id % 100 = 0 and q.vec_id <> n.vec_id),
ranked as (
  select *, row_number() over (partition by query_id order by distance, neighbor_id) as rank from pairs)
select query_id, cast(rank as bigint) as rank, neighbor_id, distance from ranked where rank <= 10
"""
