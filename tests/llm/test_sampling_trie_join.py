"""Importance resampling, conversation trie and embedding join against plain versions, on the table and on edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import bursttrie, codesearch, egojoin, importance
from tidelog.llm.common import table


def rows(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# --- importance resampling

def brute_resample(docs, target, width, buckets, percent, least_words):
    def grams(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(words), [" ".join(words[i:i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)]

    def bucket(gram):
        return zlib.crc32(gram.encode()) % buckets

    s, t = (Counter(bucket(g) for x in texts for g in grams(x)[1]) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in {*s, *t}}
    scored = []
    for doc, text in docs:
        n, own = grams(text)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in own)
        scored.append((doc, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((x for x in scored if x[1] >= least_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    ranks = defaultdict(list)
    for i, x in enumerate(able[:len(able) * percent // 100]):
        ranks[x].append(i + 1)
    return Counter((x[0], *x[2:], ranks[x].pop(0) if ranks[x] else None) for x in scored)


@pytest.mark.parametrize(("width", "buckets", "percent"), [(1, 10_000, 10), (3, 64, 60)])
def test_resampling(spark, sf, edge, width, buckets, percent):
    items = [r["text"] for r in table(spark, sf, "benchmark").collect()] + [None, ""]
    target = spark.createDataFrame([(t, 1) for t in items], "text string, score int")
    for docs in (table(spark, sf, "documents"), edge):
        own = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = importance.resample(docs, target, width, buckets, percent)
        assert rows(got, "doc_id", "n_features", "weight", "score", "rank") == brute_resample(own, items, width, buckets, percent, 20)


def test_resampling_of_empty_tables(spark, edge, nothing):
    assert importance.op11(nothing, edge).collect() == []
    drawn = importance.resample(edge, nothing, percent=100, least_words=1).where("rank is not null")
    assert sorted(r["rank"] for r in drawn.collect()) == list(range(1, drawn.count() + 1)) and drawn.count() > 5


@given(st.lists(st.binary(min_size=1, max_size=20).map(lambda b: b.replace(b" ", b"x").lower()), min_size=1, max_size=60), st.integers(1, 3), st.booleans())
@settings(max_examples=60, deadline=None)
def test_interned_slots_are_equal_where_the_bytes_are(words, width, clash):
    """Also when every key is the same: only the bytes tell strings apart then."""
    owner = np.arange(len(words)) // 7
    key = (lambda b: 5) if clash else xxhash.xxh64_intdigest
    found, slots, docs = importance.interned(words, owner, np.ones(len(words), dtype=bool), width, 97, key)
    want = [(b" ".join(words[i:i + n]), owner[i]) for n in range(1, width + 1) for i in range(len(words) - n + 1) if owner[i] == owner[i + n - 1]]
    assert [int(d) for d in docs] == [d for _, d in want]
    by_slot = {}
    for slot, (gram, _) in zip(slots.tolist(), want, strict=True):
        assert by_slot.setdefault(slot, gram) == gram
    assert len(by_slot) == len({g for g, _ in want})
    for slot, gram in by_slot.items():
        assert found.count[slot] == sum(g == gram for g, _ in want) and found.bucket[slot] == zlib.crc32(gram) % 97


def test_long_texts_in_pieces_have_the_same_features(monkeypatch):
    texts = [" ".join(f"w{i % 11}" for i in range(200)), None, "a b", "c"]
    whole = list(importance.portions(texts, 3))
    monkeypatch.setattr(importance, "LANES", 16)

    def features(parts):
        out = Counter()
        for words, owner, fresh in parts:
            found, slots, docs = importance.interned(words, owner, fresh, 3, 1000)
            out += Counter(zip(docs.tolist(), found.bucket[slots].tolist(), strict=True))
        return out

    assert features(importance.portions(texts, 3)) == features(whole)


# --- conversation trie

def brute_trie(turns, stride=100, leads=6):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    for conv, mine in own.items():
        h = zlib.crc32(str(conv).encode()) % leads
        seq = tuple(own.get(conv - int(math.fmod(conv, stride)), [])[:h] + mine[h:])
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append((conv, len(seq)))
    below = defaultdict(set)
    for path in nodes:
        for d in range(len(path) + 1):
            below[path[:d]].add(path)
    kids = Counter(path[:-1] for path in nodes if path)

    def saved(path):
        return (len(nodes[path]) - 1) * len(path[-1][1]) if path else 0

    def ends(path):
        return hashlib.sha256(",".join(str(c) for c, n in sorted(nodes[path]) if n == len(path)).encode()).hexdigest()

    return Counter((min(nodes[p])[0], len(p), min(nodes[p[:-1]])[0] if p else None, len(nodes[p]), kids[p],
                    sum(not kids[x] for x in below[p]), sum(map(saved, below[p])), ends(p)) for p in nodes)


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def talk(spark):
    """Null ids, turns, roles and texts, repeated turns and rows, copies, shared prefixes, negative ids, clashing columns."""
    out = [(None, 0, "user", "lost"), (7, None, None, None), (7, 0, "user", "a"), (7, 0, "user", "b"), (7, 0, "user", "b"), (-5, 0, "user", "x"), (-100, 0, "user", "y")]
    out += [(c, t, "user" if t % 2 else "bot", f"text {t}") for c in (*range(100, 130), 300, 301) for t in range(9)]
    out += [(c, t, "user", f"text {t if t < 7 else c}") for c in range(200, 212) for t in range(10)]
    out += [(400, t, "user", f"long {t}") for t in range(60)] + [(c, t, "u", f"twin {t}") for c in (500, 600) for t in range(40)]
    return spark.createDataFrame([(*r, 1, "k", 2) for r in out], "conv_id long, turn long, role string, text string, len int, key string, p int")


@pytest.mark.parametrize("limit", [1 << 15, 30, 3])
def test_trie(spark, sf, talk, limit):
    for turns in (table(spark, sf, "conversations"), talk):
        plain = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in turns.collect()]
        assert rows(bursttrie.trie(turns, limit=limit), *COLS) == brute_trie(plain)


def test_long_conversations_in_chunks(spark, talk, monkeypatch):
    """Chunks of joins, runs of ids and the chain of a container with one class."""
    monkeypatch.setattr(bursttrie, "CHUNK", 4)
    for turns in (talk, talk.where("conv_id in (500, 600)")):
        plain = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in turns.collect()]
        assert rows(bursttrie.trie(turns, limit=8), *COLS) == brute_trie(plain)


def test_trie_of_nothing(talk):
    out = bursttrie.op12(talk.limit(0))
    assert out.collect() == [] and sorted(out.columns) == sorted(COLS)
    assert bursttrie.op12(talk.where("conv_id is null")).collect() == []


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=6), min_size=1, max_size=25))
@settings(max_examples=100, deadline=None)
def test_sweep(sequences):
    """A container's nodes, from sorted suffixes, against all prefixes."""
    distinct = sorted({tuple(s) for s in sequences if s})
    members = [(i + 10, i % 3 + 1, "".join(x * 2 for x in s).encode(), [ord(x) for x in s]) for i, s in enumerate(distinct)]
    got = {(n[0], n[1]): n for n in bursttrie.sweep(members, 4, 1, width=2)}
    paths = {s[:d] for s in distinct for d in range(1, len(s) + 1)}
    assert len(got) == len(paths)
    for p in paths:
        inside = [(i, s) for i, s in enumerate(distinct) if s[:len(p)] == p]
        node = got[min(i for i, _ in inside) + 10, 4 + len(p)]
        under = [x for x in paths if x[:len(p)] == p]
        n = sum(i % 3 + 1 for i, _ in inside)
        kids = sum(len(x) == len(p) + 1 for x in under)
        leaves = sum(not any(len(y) > len(x) and y[:len(x)] == x for y in under) for x in under)
        saved = sum((sum(i % 3 + 1 for i, s in enumerate(distinct) if s[:len(x)] == x) - 1) * ord(x[-1]) for x in under)
        ends = next((i + 10 for i, s in inside if s == p), None)
        assert (node[3], node[4], node[5], node[6], node[7], node[8]) == (n, kids, leaves, saved, ends, len(p) == 1)


# --- embedding join

def brute_join(own, threshold=0.9):
    def sound(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)

    width = max([len(v) for _, v in own if sound(v)], default=1)
    at = [i for i, (_, v) in enumerate(own) if sound(v)]
    X = np.array([own[i][1] + [0.0] * (width - len(own[i][1])) for i in at], dtype=float).reshape(len(at), width)
    X = np.ldexp(X, -np.frexp(np.abs(X).max(axis=1))[1][:, None]) if len(X) else X
    U = X / np.sqrt((X * X).sum(axis=1))[:, None]
    hit = U @ U.T >= threshold
    near = defaultdict(set)
    for a, b in np.argwhere(hit).tolist():
        near[at[a]].add(at[b])
    out = []
    for i, (vec, _) in enumerate(own):
        seen, todo = {i}, [i]
        while todo:
            fresh = near[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        least = min((own[j][0] for j in seen if own[j][0] is not None), default=None)
        out.append((vec, len(near[i] - {i}), least, vec is not None and vec == least))
    return Counter(out)


@pytest.fixture(scope="module")
def clouds(spark):
    """Tight, loose and chained groups, copies, scaled copies, unsound vectors, repeated and null ids, clashing columns."""
    rng = np.random.default_rng(3)
    out = []
    for spread, size in ((0.01, 150), (0.08, 60), (0.3, 60)):
        center = rng.normal(size=12)
        out += [(center + spread * rng.normal(size=12)).tolist() for _ in range(size)]
    turn = np.linspace(0, 3, 40)
    out += [[math.cos(a), math.sin(a)] + [0.0] * 10 for a in turn] + rng.normal(size=(100, 12)).tolist()
    out += [out[0]] * 30 + [(1e200 * np.array(out[1])).tolist(), (1e-200 * np.array(out[1])).tolist(), [1.0, 2.0], [1.0, 2.0, 0.0]]
    out += [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] * 12, [None] + [1.0] * 11, None]
    ids = [*range(len(out) - 4, 0, -1), 5, 5, None, None]
    return spark.createDataFrame([(i, v, 0, 1, "r") for i, v in zip(ids, out, strict=True)],
                                 "vec_id long, embedding array<double>, row int, w int, cls string")


@pytest.mark.parametrize(("tile", "leaf", "fan"), [(8192, 512, 16), (16, 4, 2)])
def test_embedding_join(spark, sf, clouds, tile, leaf, fan):
    for vectors in (clouds, table(spark, sf, "embeddings")):
        own = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
        got = egojoin.near_vectors(vectors, tile=tile, leaf=leaf, fan=fan)
        assert rows(got, "vec_id", "n_links", "component_id", "kept") == brute_join(own)


def test_whole_intervals_are_counted_without_comparing(spark, clouds, monkeypatch):
    """A tight group is linked interval by interval: no tile of it is compared."""
    tight = clouds.where("vec_id is not null").orderBy(clouds.vec_id.desc()).limit(150)
    asked = []
    plain = egojoin.compared
    monkeypatch.setattr(egojoin, "compared", lambda packs, pairs, *rest: (asked.append(pairs.count()), plain(packs, pairs, *rest))[1])
    got = egojoin.near_vectors(tight, tile=16, leaf=4, fan=2)
    assert {tuple(r) for r in got.select("n_links").collect()} == {(149,)} and asked == [0]


def test_embedding_join_of_nothing(clouds):
    assert egojoin.op13(clouds.limit(0)).collect() == []
    alone = egojoin.op13(clouds.where("vec_id is null or embedding is null")).collect()
    assert all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] for r in alone)


@pytest.mark.parametrize(("sql", "run", "tables"), [
    (importance.SQL, lambda t: importance.op11(t("documents"), t("benchmark")), ["documents", "benchmark"]),
    (bursttrie.SQL, lambda t: bursttrie.op12(t("conversations")), ["conversations"]),
    (egojoin.SQL, lambda t: egojoin.op13(t("embeddings")), ["embeddings"])])
def test_sql_twins(spark, sf, sql, run, tables):
    con = duckdb.connect()
    for name in tables:
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    want = con.sql(sql)
    assert rows(run(lambda name: table(spark, sf, name)), *want.columns) == Counter(want.fetchall())


# --- exact search in codes

def test_code_search_of_repeated_ids_and_clashing_columns(spark):
    """An id with many near codes takes one place; ids that ask or answer with several codes are as near as the nearest."""
    rng = np.random.default_rng(9)
    rows_ = [(i, (rng.integers(0, 2, 16) * 2 - 1).astype(float).tolist()) for i in range(40)]
    base = rows_[0][1]
    for b in range(12):  # one other id close by with a dozen codes
        rows_.append((77, [-x if i == b else x for i, x in enumerate(base)]))
    rows_ += [(0, base), (5, base), (78, base), (78, base), (None, base), (90, None), (0, [-x for x in base])]
    rows_ += [(200 + i, base) for i in range(15)]
    df = spark.createDataFrame([(i, v, 0, 1, "q", 2) for i, v in rows_], "vec_id long, embedding array<double>, rank int, worst int, query string, segment int")
    codes = [(i, np.array([x > 0 for x in v])) for i, v in rows_ if i is not None and v is not None]
    for k, parts in ((5, None), (5, codesearch.cut(16, 4)), (20, codesearch.cut(16, 2))):
        want = Counter()
        for q in {i for i, _ in codes if i % 5 == 0}:
            near = {}
            for a, x in codes:
                for b, y in codes:
                    if a == q and b != q:
                        near[b] = min(near.get(b, 99), int((x != y).sum()))
            for rank, (b, d) in enumerate(sorted(near.items(), key=lambda e: (e[1], e[0]))[:k], 1):
                want[q, rank, b, d] += 1
        got = codesearch.top_k(df, df.where("vec_id % 5 = 0"), k=k, bits=16, parts=parts)
        assert rows(got, "query_id", "rank", "neighbor_id", "distance") == want
    assert codesearch.top_k(df, df.where("vec_id < 0"), k=3, bits=16).collect() == []


def test_steps_of_a_cut_cover_every_code():
    """After each step, every code that no segment met is farther than the step says."""
    rng = np.random.default_rng(2)
    parts = codesearch.cut(40, 3)
    assert sum(n for _, n in parts) == 40 and {a // 32 == (a + n - 1) // 32 for a, n in parts} == {True}
    codes = rng.integers(0, 2, (3000, 40)) * (rng.random((3000, 1)) < 0.9) * (rng.random((3000, 40)) < rng.random((3000, 1)))
    weights = np.array([codes[:, a:a + n].sum(axis=1) for a, n in parts])
    radius = np.full(len(parts), -1)
    for r, grown, reach in codesearch.steps(parts):
        radius[grown] = r
        missed = (weights > radius[:, None]).all(axis=0)
        assert not missed.any() or codes[missed].sum(axis=1).min() > reach
    assert reach == 40
