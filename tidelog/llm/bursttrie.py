"""Prefix trie of conversations as a burst trie over Spark tables.

A turn is the md5 of its role and text. Equal sequences are one class. Classes
start in one suffix container under the root; a container beyond ``limit`` turns
bursts by next turn: each child becomes a trie head with a container of its own,
named by the hash of its path, so that a burst is one grouped aggregation
however many conversations share the turn. Containers within the limit are dealt
to shards by name, sorted, and swept once with a stack into nodes. A container
beyond the limit that holds a single class is a chain and needs no burst. Heads
add up their children's leaves and tokens from the deepest burst to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import ready, stash, text_of
from tidelog.session import running_total

LIMIT = 1 << 15
CHUNK = 4096
BROADCAST_ROWS = 100_000
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends long, container binary")


def _joined(rows: DataFrame, few: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with a written table, broadcast only when it counts at most BROADCAST_ROWS rows."""
    return rows.join(F.broadcast(few) if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else few, on, how)


def _chunks(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((count - 1) / CHUNK))))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv, pos, key, chars): positions from 0 by turn, nulls first, then by the turn's hash.

    Turns are dealt by range of (conversation, turn), so a long conversation
    spans many slices; only the one conversation that a slice continues has an offset.
    """
    role, text = text_of("role"), text_of("text")
    rows = stash(turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("key"), F.length(text).alias("chars")))
    order = [F.col("turn").asc_nulls_first(), F.col("key")]
    slices = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stash(rows.repartitionByRange(slices, F.col("conv"), *order).withColumn("slice", F.spark_partition_id()))
    earlier = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("conv", "slice").count().withColumn("start", F.sum("count").over(earlier)).where(
        "start is not null").select("conv", "slice", "start")  # at most one row for each slice
    pos = F.row_number().over(Window.partitionBy("conv", "slice").orderBy(*order)) - 1
    return dealt.withColumn("pos", pos).join(F.broadcast(starts), ["conv", "slice"], "left").select(
        "conv", (F.col("pos") + F.coalesce("start", F.lit(0))).alias("pos"), "key", "chars")


def rebuilt(turns: DataFrame, stride: int = 100, leads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conv, m) and its rows (conv, p, key, chars): the first h turns of conversation c - c % stride, then c's own after its first h."""
    rows = stash(numbered(turns))
    heads = stash(rows.where((F.col("pos") < leads - 1) & (F.col("conv") % stride == 0)).select(
        F.col("conv").alias("base"), "pos", "key", "chars"))
    convs = rows.groupBy("conv").agg(F.count("*").alias("n")).select(
        "conv", "n", (F.crc32(F.col("conv").cast("string")) % leads).alias("h"), (F.col("conv") - F.col("conv") % stride).alias("base"))
    taken = F.least("h", F.coalesce("held", F.lit(0).cast("long")))
    convs = stash(convs.join(heads.groupBy("base").agg(F.count("*").alias("held")), "base", "left").select(
        "conv", "n", "h", "base", taken.alias("taken"), (taken + F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("h"))).alias("m")))
    own = rows.withColumn("chunk", F.floor(F.col("pos") / CHUNK)).join(
        convs.select("conv", "h", "taken", _chunks(F.col("n")).alias("chunk")), ["conv", "chunk"]).where("pos >= h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("p"), "key", "chars")
    lent = convs.where("taken > 0").join(heads, "base").where("pos < taken").select("conv", F.col("pos").alias("p"), "key", "chars")
    return convs.select("conv", "m"), stash(own.union(lent))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, m, conv) in this order -> runs of one sequence: its first id, how many, the ids as text; at most CHUNK a row."""
    names = ["seq", "m", "at", "first", "n", "ids"]
    seq, length, ids = None, 0, []

    def told() -> tuple:
        return seq, length, ids[0], ids[0], len(ids), ",".join(map(str, ids)).encode()

    for batch in batches:
        out = []
        for s, m, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids and (s != seq or len(ids) == CHUNK):
                out.append(told())
                ids = []
            seq, length = s, m
            ids.append(conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _LISTED, strict=True)], names)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(told(), _LISTED, strict=True)], names)


_LISTED = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, m, at, first, n, ids) sorted by seq and at -> one row a sequence: class, length, members, SHA-256 of the joined ids."""
    held = None

    def told(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [
            pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)], ["cls", "len", "w", "digest"])

    def row() -> tuple:
        return held["cls"], held["m"], held["n"], held["sha"].hexdigest()

    for batch in batches:
        out = []
        for seq, m, _, first, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None or held["seq"] != seq:
                if held:
                    out.append(row())
                held = {"seq": seq, "m": m, "cls": first, "n": n, "sha": hashlib.sha256(ids)}
            else:
                held["n"] += n
                held["sha"].update(b"," + ids)
        if out:
            yield told(out)
    if held:
        yield told([row()])


def classes_of(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """(cls, len, w, digest): each distinct sequence with its least conversation, its count, and the digest of all its ids.

    A digest reads its ids in order, so the last step of a class is sequential;
    it streams runs of ids that were joined side by side before.
    """
    prints = rows.groupBy("conv").agg(F.count("*").alias("m"), *[
        F.sum(F.xxhash64(F.lit(s), "p", "key").cast("decimal(38,0)")).alias(f"s{s}") for s in (1, 2)])
    # the fingerprints stand beside the conversations without turns, which have none
    seqs = prints.select("conv", "m", F.unhex(F.md5(F.concat_ws(",", "s1", "s2", "m"))).alias("seq")).union(
        convs.where("m = 0").select("conv", "m", F.lit(b"").alias("seq")))
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seqs = stash(seqs.select("seq", "m", "conv"))
    runs = ready(seqs).repartitionByRange(slices, "seq", "conv").sortWithinPartitions("seq", "conv").mapInArrow(
        _listed, "seq binary, m long, at long, first long, n long, ids binary")
    return stash(runs.repartition(slices, "seq").sortWithinPartitions("seq", "at").mapInArrow(
        _digests, "cls long, len long, w long, digest string"))


def sweep(members: list[tuple[int, int, bytes, list[int]]], depth: int, head: int, width: int = 16) -> list[tuple]:
    """Nodes of one container.

    ``members``: (class, count, hashes of its turns below ``depth``, their code
    points). Sequences are sorted; a node closes once the next one leaves it.
    Returns (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends, is_top).
    """
    out: list[tuple] = []
    # an open node: least member, members, code points, class that ends here, closed children
    path: list[list] = [[head, 0, 0, None, []]]

    def close() -> None:
        conv, n, chars, ends, below = path.pop()
        at = depth + len(path)
        saved = (n - 1) * chars + sum(c[6] for c in below)
        leaves = sum(c[5] for c in below) or 1
        out.extend((*c[:2], conv, *c[3:]) for c in below)
        up = path[-1]
        up[4].append((conv, at, None, n, len(below), leaves, saved, ends, len(path) == 1))
        if len(path) > 1:
            up[0], up[1] = min(up[0], conv), up[1] + n

    before = b""
    for cls, w, keys, chars in sorted(members, key=lambda m: m[2]):
        turns, shared = len(keys) // width, 0
        most = min(turns, len(before) // width)
        while shared < most and keys[shared * width:(shared + 1) * width] == before[shared * width:(shared + 1) * width]:
            shared += 1
        while len(path) - 1 > shared:
            close()
        for i in range(shared, turns):
            path.append([cls, 0, chars[i], None, []])
        path[-1][1] += w
        path[-1][0] = min(path[-1][0], cls)
        path[-1][3] = cls
        before = keys
    while len(path) > 1:
        close()
    out.extend((*c[:2], head, *c[3:]) for c in path[0][4])
    return out


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(container, cls, p, depth, head, w, key, chars) sorted by the first three -> nodes; one container in memory."""
    kinds = [pa.int64()] * 8 + [pa.binary()]
    names = [f.split()[0] for f in NODE.split(", ")]

    def told(container: bytes, rows: list) -> list[tuple]:
        members = []
        for cls, own in groupby(rows, key=lambda r: r[1]):
            own = list(own)
            members.append((cls, own[0][5], b"".join(r[6] for r in own), [r[7] for r in own]))
        return [(*n[:8], container if n[8] else None) for n in sweep(members, rows[0][3], rows[0][4])]

    held: list = []
    out: list = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                out += told(held[0][0], held)
                held = []
                if len(out) >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
            held.append(row)
    if held:
        out += told(held[0][0], held)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _chains(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """Nodes of containers that hold one class and more turns than the limit: no branch, running sums only."""
    own = _joined(rows.drop("len"), chains, ["cls"], "inner").where("p >= depth").withColumn(
        "value", (F.col("w") - 1) * F.col("chars"))
    summed = running_total(own, ["cls"], [F.col("p").desc()], {"saved": "value"})
    last, first = F.col("p") == F.col("len") - 1, F.col("p") == F.col("depth")
    return summed.select(
        F.col("cls").alias("conv_id"), (F.col("p") + 1).alias("depth"), F.when(first, F.col("head")).otherwise(F.col("cls")).alias("parent_conv_id"),
        F.col("w").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.when(last, F.col("cls")).alias("ends"), F.when(first, F.col("container")).alias("container"))


def trie(turns: DataFrame, stride: int = 100, leads: int = 6, limit: int = LIMIT) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    ``turns`` has conv_id, turn, role and text; other columns are not read. A
    null role or text is empty, a null turn comes first; turns with one number
    are ordered by their hash, and repeated rows are turns of their own. Rows
    without a conv_id belong to no conversation. An empty table has no nodes,
    not even the root. Sequences are equal up to 128-bit hashes.
    """
    convs, rows = rebuilt(turns, stride, leads)
    classes = classes_of(convs, rows)
    rows = stash(rows.withColumn("chunk", F.floor(F.col("p") / CHUNK)).join(
        classes.select(F.col("cls").alias("conv"), "len", _chunks(F.col("len")).alias("chunk")), ["conv", "chunk"]).select(
        F.col("conv").alias("cls"), "len", "p", "key", F.col("chars").cast("long").alias("chars")))
    top = classes.agg(F.min("cls").alias("conv_id"), F.sum("w").alias("n"), F.sum("len").alias("turns"),
                      F.max(F.when(F.col("len") == 0, F.col("cls"))).alias("ends"), F.count_if(F.col("len") > 0).alias("live")).first()
    spark = turns.sparkSession
    if top["n"] is None:
        return spark.createDataFrame([], NODE).drop("container", "ends").withColumn("ends_sha256", F.lit(""))
    name = b"\0" * 16
    heads = [spark.createDataFrame([(name, None, None, top["conv_id"], top["n"], 0, top["ends"])],
                                   "container binary, parent binary, parent_conv_id long, conv_id long, n_convs long, chars long, ends long")]
    live = classes.where("len > 0").select("cls", "len", "w", F.lit(name).alias("container"), F.lit(top["conv_id"]).alias("head"))
    live = live.withColumn("depth", F.lit(0).cast("long"))
    placed, chains, bursting = [], [], None
    if top["turns"] <= limit:
        placed.append(live)
    elif top["live"] == 1:
        chains.append(live)
    else:
        bursting = live
    depth = 0
    while bursting is not None:
        step = stash(rows.where(F.col("p") == depth).select("cls", "key", "chars").join(bursting, "cls").select(
            "cls", "len", "w", F.col("container").alias("parent"), F.col("head").alias("parent_conv_id"),
            F.unhex(F.md5(F.concat("container", "key"))).alias("container"), "chars"))
        depth += 1
        below = F.col("len") > depth
        stats = stash(step.groupBy("container", "parent", "parent_conv_id").agg(
            F.min("cls").alias("conv_id"), F.sum("w").alias("n_convs"), F.max("chars").alias("chars"),
            F.max(F.when(~below, F.col("cls"))).alias("ends"), F.sum(F.col("len") - depth).alias("turns"), F.count_if(below).alias("live")))
        heads.append(stats.select("container", "parent", "parent_conv_id", "conv_id", "n_convs", "chars", "ends"))
        # a level has at most turns / limit containers beyond the limit
        large = stash(stats.where(F.col("turns") > limit).select("container", F.col("conv_id").alias("head"), "live"))
        live = step.where(below).select("cls", "len", "w", "container")
        split = _joined(live, large, ["container"], "left").withColumn("depth", F.lit(depth).cast("long"))
        cols = ["cls", "len", "w", "container", "head", "depth"]
        small = split.where("head is null").drop("head").join(stats.select("container", F.col("conv_id").alias("head")), "container")
        placed.append(small.select(*cols))
        chains.append(split.where("live = 1").select(*cols))
        bursting = stash(split.where("live > 1").select(*cols)) if large.where("live > 1").limit(1).count() else None
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = [spark.createDataFrame([], NODE)]
    if placed:
        every = placed[0]
        for more in placed[1:]:
            every = every.union(more)
        # a placed class has at most limit turns below its head, so no class is a hot key here
        own = rows.where(F.col("len") <= limit + depth).drop("len").join(stash(every).drop("len"), "cls").where("p >= depth").select(
            "container", "cls", "p", "depth", "head", "w", "key", "chars")
        parts.append(own.repartition(slices, "container").sortWithinPartitions("container", "cls", "p").mapInArrow(_swept, NODE))
    if chains:
        every = chains[0]
        for more in chains[1:]:
            every = every.union(more)
        every = stash(every)
        if every.limit(1).count():
            parts.append(_chains(rows, every))
    nodes = parts[0]
    for more in parts[1:]:
        nodes = nodes.unionByName(more)
    nodes = stash(nodes)
    tops = nodes.where("container is not null").select("container", "n_leaves", "saved_tokens")
    done, lower = [nodes.drop("container")], None
    for level in range(len(heads) - 1, -1, -1):
        children = tops if lower is None else tops.union(lower.select(F.col("parent").alias("container"), "n_leaves", "saved_tokens"))
        sums = children.groupBy("container").agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        lower = stash(heads[level].join(sums, "container", "left").select(
            "parent", "conv_id", F.lit(level).cast("long").alias("depth"), "parent_conv_id", "n_convs",
            F.coalesce("c", F.lit(0)).cast("long").alias("n_children"), F.coalesce("l", F.lit(1)).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("s", F.lit(0))).cast("long").alias("saved_tokens"), "ends"))
        done.append(lower.drop("parent"))
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    named = nodes.where("ends is not null").join(classes.select(F.col("cls").alias("ends"), F.col("digest").alias("ends_sha256")), "ends")
    rest = nodes.where("ends is null").withColumn("ends_sha256", F.sha2(F.lit(""), 256))
    return named.unionByName(rest).drop("ends")


def op12(turns: DataFrame) -> DataFrame:
    return trie(turns)


SQL = """
with recursive bytes as (select b from range(256) r(b)),
crc_step(b, c, i) as (
  select b, b, 0 from bytes union all
  select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i + 1 from crc_step where i < 8),
crc_table as (select b, c from crc_step where i = 8),
numbered as (
  select conv_id, md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as key,
    length(coalesce(text, '')) as chars,
    row_number() over (partition by conv_id order by turn nulls first, key) - 1 as pos
  from conversations where conv_id is not null),
crc(conv_id, s, i, c) as (
  select distinct conv_id, conv_id::varchar, 0, 4294967295::bigint from numbered union all
  select conv_id, s, i + 1, xor(k.c >> 8, t.c) from crc k join crc_table t on t.b = xor(k.c & 255, ascii(substr(s, i + 1, 1)))
  where i < length(s)),
convs as (select conv_id, conv_id - conv_id % 100 as base, xor(c, 4294967295) % 6 as h from crc where i = length(s)),
parts as (
  select c.conv_id, 0 as part, pos, key, chars from convs c join numbered b on b.conv_id = c.base and b.pos < c.h
  union all select conv_id, 1, pos, key, chars from numbered join convs using (conv_id) where pos >= h),
placed as (
  select conv_id, chars, row_number() over w as depth, md5(string_agg(key, '') over w) as node from parts
  window w as (partition by conv_id order by part, pos)),
paths as (
  select conv_id, 0 as depth, '' as node, 0 as chars, null::varchar as up from convs union all
  select conv_id, depth, node, chars, coalesce(lag(node) over (partition by conv_id order by depth), '') from placed),
lengths as (select conv_id, max(depth) as len from paths group by conv_id),
nodes as (
  select node, depth, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(chars) as own,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (depth = len), '') as ends
  from paths join lengths using (conv_id) group by node, depth),
children as (select up as node, count(*) as n_children from nodes where up is not null group by up),
full_nodes as (
  select n.*, coalesce(n_children, 0) as n_children from nodes n left join children using (node)),
below as (
  select a.node, sum(x.own)::bigint as saved, count(*) filter (x.n_children = 0) as n_leaves
  from full_nodes x join paths a on a.conv_id = x.conv_id and a.depth <= x.depth group by a.node)
select n.conv_id::bigint as conv_id, n.depth::bigint as depth, p.conv_id::bigint as parent_conv_id, n.n_convs::bigint as n_convs,
  n.n_children::bigint as n_children, b.n_leaves::bigint as n_leaves, b.saved as saved_tokens, sha256(n.ends) as ends_sha256
from full_nodes n join below b using (node) left join nodes p on p.node = n.up
"""
