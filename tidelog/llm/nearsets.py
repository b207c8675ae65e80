"""Near copies by SimHash and exact set similarity: all pairs of texts whose word shingles reach a Jaccard of 0.8.

A text is the set of its 64-bit shingle hashes; equal sets are one class. Under
any one order of all shingles, two sets of Jaccard 0.8 share a shingle among the
first ``n - ceil(0.8 n) + 1`` of each (prefix filter), so no pair is missed. The
order is by hash at first; shingles that too many prefixes hold then move behind
all others, the more the farther, and only the prefixes that held them are built
again. The first shingle that two sets share has a place in each that bounds
their overlap (positional filter), so pairs are made where that bound allows 0.8.

SimHash over the same shingles proposes the first pairs: fingerprints that are
equal or within two bits. That is a similarity well above 0.8, so it cannot
propose all; classes that share a prefix shingle are compared as well, first
with the one of them, of like size, that has the fewest rarer shingles before
it: around a text with many copies that is the copy with the fewest changes.
Every pair is settled by its whole sets. What these links leave in different
components is then compared pair by pair, each shingle's main
component only with the classes outside it. Counts of a set's hashes by their
leading bits bound the overlap from above, so whole sets are read only for pairs
within that bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import simhash
from tidelog.llm.common import drop, free_name, join_counted, ready, scope, stash
from tidelog.llm.components import connected_components

SHINGLE = 5
ROWS = 512
FILTER_BITS = 23
HOT = 4
ROUNDS = 4
HOT_ROWS = 4_000_000
CROWD = 50_000
LIKE = math.log(1.118)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than ``width`` are one shingle."""
    words = (text or "").encode().lower().split()
    joined, last = b" ".join(words), max(1, len(words) - width + 1)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:last]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], 42) for s, e in zip(
        starts.tolist(), ends[min(width, len(words)) - 1:].tolist(), strict=True)), dtype=np.uint64, count=last))


def kept_of(n: int) -> int:
    """Length of the prefix of a set of ``n`` shingles."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def prefix(own: np.ndarray, hot: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first shingles of a set (signed hashes), ordered by level, then hash; ``hot`` is sorted, all others have level 0."""
    behind = np.zeros(len(own), dtype=np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        behind = np.where(hot[at] == own, level[at], 0)
    return own[np.lexsort((own, behind))[:kept_of(len(own))]]


def cells(own: np.ndarray) -> bytes:
    """How many hashes have the same leading bits, 255 for more; about four a cell."""
    bits = max(8, (len(own) // 4).bit_length())
    counts = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def may_reach(x: bytes, y: bytes, n_x: int, n_y: int) -> bool:
    """Whether the cells of two sets allow a Jaccard of 0.8; full cells allow anything."""
    a, b = (np.frombuffer(c, dtype=np.uint8).astype(np.int64) for c in (x, y))
    if a.max() == 255 or b.max() == 255:
        return True
    least = min(len(a), len(b))
    common = np.minimum(a.reshape(least, -1).sum(axis=1), b.reshape(least, -1).sum(axis=1)).sum()
    return 9 * int(common) >= 4 * (n_x + n_y)


def _marked(width: int) -> Callable:
    none = np.zeros(0, dtype=np.int64)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, text) -> row, class, set size, prefix by hash, cells."""
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = [shingles(t, width) for t in part.column(1).to_pylist()]
                names = np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()),
                     pa.array([prefix(s.view(np.int64), none, none) for s in sets], pa.list_(pa.int64())),
                     pa.array([cells(s) for s in sets], pa.binary())], ["row", "cid", "n", "tokens", "cells"])
    return marked


def _places(rows: np.ndarray) -> np.ndarray:
    return ((rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_places(batch.column(0).to_numpy()))], ["place"])


def _marks(rows: DataFrame) -> np.ndarray:
    """A bit for each place of a row number: a filter of fixed size, put together by aggregation."""
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    words = rows.select("row").mapInArrow(_placed, "place long").groupBy(F.floor(F.col("place") / 64).alias("word")).agg(
        F.bit_or(bit).alias("bits")).collect()
    seen = np.zeros(1 << FILTER_BITS >> 6, dtype=np.int64)
    for r in words:
        seen[r["word"]] = r["bits"]
    return np.unpackbits(seen.view(np.uint8), bitorder="little").astype(bool)


def _chosen_sets(texts: DataFrame, wanted: DataFrame, width: int, of_set: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(cid, hashes): ``of_set`` of the signed hashes of the texts whose rows are ``wanted`` (row, cid); others are not shingled."""
    marks = np.packbits(_marks(wanted)).tobytes()

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(np.frombuffer(marks, dtype=np.uint8)).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(seen[_places(batch.column(0).to_numpy())]))
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(
                    [of_set(shingles(t, width).view(np.int64)) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))], ["row", "hashes"])

    return texts.select("row", "text").mapInArrow(chosen, "row long, hashes array<long>").join(wanted, "row").select("cid", "hashes")


def _reordered(texts: DataFrame, wanted: DataFrame, hot: DataFrame, width: int, hot_rows: int) -> DataFrame:
    """(cid, fresh): the prefixes of the ``wanted`` classes under the order with ``hot`` (token, level).

    A table of at most ``hot_rows`` goes to the tasks as two arrays; a larger one is joined with the shingles.
    """
    if hot.limit(hot_rows + 1).count() <= hot_rows:
        known = hot.toPandas().sort_values("token")
        sent = texts.sparkSession.sparkContext.broadcast(tuple(known[c].to_numpy(dtype=np.int64) for c in ("token", "level")))
        return _chosen_sets(texts, wanted, width, lambda own: prefix(own, *sent.value)).withColumnRenamed("hashes", "fresh")
    rows = _chosen_sets(texts, wanted, width, lambda own: own).select("cid", F.explode("hashes").alias("token")).join(hot, "token", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("level", F.lit(0)).alias("level"), "token")))
    n = F.size("tokens")
    return rows.groupBy("cid").agg(order["token"].alias("tokens")).select(
        "cid", F.slice("tokens", F.lit(1), n - F.floor((4 * n + 4) / 5).cast("int") + 1).alias("fresh"))


def prefixes(texts: DataFrame, classes: DataFrame, width: int, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(cid, n, tokens) under the last order, and (token, count) of the shingles that over HOT prefixes hold.

    Every round moves the shingles back that turned out frequent; a shingle gets
    its level once, so the order is the same for all. A round more or less
    changes how many pairs are looked at, never which are found.
    """
    held, hot = classes.select("cid", "n", "tokens"), None
    for done in range(ROUNDS + 1):
        counts = stash(held.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") > HOT))
        if done == ROUNDS:
            break
        new = counts if hot is None else counts.join(hot, "token", "left_anti")
        new = stash(new.select("token", (1 + F.floor(F.log2("count"))).cast("long").alias("level")))
        if not new.limit(1).count():
            break
        moved = join_counted(held.select("cid", F.explode("tokens").alias("token")), new, ["token"], "left_semi")
        wanted = stash(moved.select("cid").distinct().join(classes.select("cid", "row"), "cid"))
        last, hot = hot, new if hot is None else stash(hot.union(new))
        fresh = stash(_reordered(texts, wanted, hot, width, hot_rows))
        before, held = held, stash(held.join(fresh, "cid", "left").select("cid", "n", F.coalesce("fresh", "tokens").alias("tokens")))
        drop(*[t for t in (before, last, wanted, fresh, counts) if t is not None and hasattr(t, "stash_path")])
    return held, counts


def _least_overlap(n: int, m: int) -> int:
    return -(-4 * (n + m) // 9)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, salt, like, pos, cid, n) in this order -> rows whose token another row has, with the class to compare first, or null.

    The first row of a (token, salt, like) is compared with the others. Rows of salted tokens always have others.
    """
    held = np.zeros((0, 6), dtype=np.int64)
    before, hub = None, None

    def told(rows: np.ndarray, after: int | None) -> pa.RecordBatch:
        nonlocal before, hub
        token = rows[:, 0]
        same = np.concatenate([[before is not None and token[0] == before], token[1:] == token[:-1]])
        follows = np.concatenate([same[1:], [after is not None and token[-1] == after]])
        before = int(token[-1])
        out, hubs = np.flatnonzero(same | follows | (rows[:, 1] >= 0)), []
        for row in rows[out].tolist():
            first = None
            if hub is None or hub[:3] != row[:3]:
                hub = row
            else:
                need = _least_overlap(hub[5], row[5])
                if hub[3] <= hub[5] - need and row[3] <= row[5] - need:
                    first = hub[4]
            hubs.append(first)
        return pa.RecordBatch.from_arrays([*(pa.array(rows[out, c]) for c in (0, 3, 4, 5)), pa.array(hubs, pa.int64())],
                                          ["token", "pos", "cid", "n", "hub"])

    for batch in batches:
        rows = np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns])
        if len(rows):
            if len(held):
                yield told(held, int(rows[0, 0]))
            held = rows
    if len(held):
        yield told(held, None)


def _reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, n_b, cells_a, cells_b) -> the pairs (a, b) whose cells allow a Jaccard of 0.8."""
    for batch in batches:
        near = [may_reach(x, y, n, m) for n, m, x, y in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))


def _near(pairs: DataFrame, texts: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets have a Jaccard of at least 0.8, written."""
    a, b = (classes.select(F.col("cid").alias(s), F.col("n").alias(f"n_{s}"), F.col("cells").alias(f"cells_{s}")) for s in "ab")
    pairs = stash(pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "cells_a", "cells_b").mapInArrow(
        _reachable, "a long, b long"))
    wanted = stash(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct().join(
        classes.select("cid", "row"), "cid"))
    sets = stash(_chosen_sets(texts, wanted, width, lambda own: own))
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("hashes").alias("x")), "a").join(
        sets.select(F.col("cid").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    near = stash(both.where(9 * common >= 4 * (F.size("x") + F.size("y"))).select("a", "b"))
    drop(pairs, wanted, sets)
    return near


def _allowed() -> Column:
    """Whether sizes and places of a shared shingle on sides x and y allow a Jaccard of 0.8, if no shingle before it is shared."""
    need = F.ceil(4 * (F.col("n_x") + F.col("n_y")) / 9)
    return (5 * F.least("n_x", "n_y") >= 4 * F.greatest("n_x", "n_y")) & (F.col("pos_x") <= F.col("n_x") - need) & (
        F.col("pos_y") <= F.col("n_y") - need)


def _left_apart(held: DataFrame) -> DataFrame:
    """(token, pos, cid, n, root) -> pairs (a, b) of different roots that a token allows.

    Of each token, only classes outside its most frequent root meet the others.
    """
    roots = held.groupBy("token", "root").agg(F.count("*").alias("rows"))
    main = stash(roots.groupBy("token").agg(F.max_by("root", F.struct("rows", "root")).alias("main"), F.count("*").alias("roots")).where(
        "roots > 1").select("token", "main"))
    split = stash(held.join(main, "token"))
    x, y = (rows.select("token", "main", *[F.col(c).alias(f"{c}_{s}") for c in ("pos", "cid", "n", "root")])
            for s, rows in (("x", split.where("root <> main")), ("y", split)))
    met = x.join(y.drop("main"), "token").where((F.col("root_x") != F.col("root_y")) & _allowed() & (
        (F.col("root_y") == F.col("main")) | (F.col("cid_x") < F.col("cid_y"))))
    pairs = stash(met.select(F.least("cid_x", "cid_y").alias("a"), F.greatest("cid_x", "cid_y").alias("b")).distinct())
    drop(main, split)
    return pairs


def _simhash_pairs(texts: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) of classes that SimHash of the same shingles links, written: a spanning forest of its links.

    Links are equal fingerprints and those within two bits.
    """
    prints = simhash.fingerprints(texts, "row", "text", width).withColumnRenamed("doc_id", "row")
    prints = stash(prints.join(classes.select("row", "cid"), "row").select("cid", "fp"))
    least = stash(prints.groupBy("fp").agg(F.min("cid").alias("least")))
    a, b = (least.select(F.col("fp").alias(s), F.col("least").alias(f"least_{s}")) for s in "ab")
    near = simhash.near_links(least.select("fp")).join(a, "a").join(b, "b").select("least_a", "least_b")
    met = prints.join(least, "fp").where("cid <> least").select("cid", "least").union(near).toDF("x", "y")
    pairs = stash(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    drop(prints, least)
    return pairs


def near_sets(texts: DataFrame, width: int = SHINGLE, hot_rows: int = HOT_ROWS, crowd: int = CROWD) -> DataFrame:
    """(row, text) with unique rows, written -> (row, group), written: groups are the closure of Jaccard 0.8.

    Null texts are empty ones; all texts without words are one group.
    """
    with scope() as kept:
        marked = stash(ready(texts).select("row", "text").mapInArrow(
            _marked(width), "row long, cid long, n int, tokens array<long>, cells binary"))
        least = marked.groupBy("cid").agg(F.min("row").alias("row"))
        classes = stash(marked.join(least.select("row"), "row", "left_semi"))
        members = stash(marked.select("row", "cid"))
        drop(marked)
        held, counts = prefixes(texts, classes, width, hot_rows)
        # a shingle of very many prefixes is dealt out over tasks, each part with a class to compare first
        crowded = stash(counts.where(F.col("count") > crowd).select("token", F.ceil(F.col("count") / crowd).alias("parts")))
        tokens = held.select("cid", F.col("n").cast("long").alias("n"), F.posexplode("tokens").alias("pos", "token"))
        tokens = join_counted(tokens, crowded, ["token"], "left").select(
            "token", F.coalesce(F.pmod(F.xxhash64("cid"), F.col("parts")), F.lit(-1)).alias("salt"),
            F.floor(F.log("n") / LIKE).alias("like"), F.col("pos").cast("long").alias("pos"), "cid", "n")
        slices = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = ["token", "salt", "like", "pos", "cid"]
        shared = stash(tokens.repartition(slices, "token", "salt").sortWithinPartitions(*order).mapInArrow(
            _shared, "token long, pos long, cid long, n long, hub long"))
        first = stash(shared.where("hub is not null").select(
            F.least("hub", "cid").alias("a"), F.greatest("hub", "cid").alias("b")).distinct())
        if held is not classes:
            drop(held)
        first = stash(first.union(_simhash_pairs(texts, classes, width)).distinct())
        links = _near(first, texts, classes, width)
        roots = stash(connected_components(links))
        rooted = stash(shared.join(roots, shared["cid"] == roots["node"], "left").select(
            "token", "pos", "cid", "n", F.coalesce("root", "cid").alias("root")))
        drop(shared)
        apart = _left_apart(rooted)
        drop(rooted)
        more = _near(apart.join(first, ["a", "b"], "left_anti"), texts, classes, width)
        roots = stash(connected_components(links.union(more)))
        groups = stash(members.join(roots, members["cid"] == roots["node"], "left").select(
            "row", F.coalesce("root", "cid").alias("group")))
        kept.append(groups)
    return groups


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each near-copy group: the least id, nulls last, then the first row as written."""
    row = free_name(docs, "row")
    with scope() as kept:
        docs = stash(docs.withColumn(row, F.monotonically_increasing_id()))
        groups = near_sets(docs.select(F.col(row).alias("row"), F.col(text_col).alias("text")), width)
        order = F.struct(F.col("id").isNull().alias("missing"), "id", "row")
        ids = docs.select(F.col(row).alias("row"), F.col(id_col).alias("id"))
        stay = stash(groups.join(ids, "row").groupBy("group").agg(F.min(order).alias("least")).select(F.col("least.row").alias(row)))
        kept += [docs, stay]
    return docs.join(stay, row, "left_semi").drop(row)
