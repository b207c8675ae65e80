"""Properties of the methods themselves."""

import hashlib
import math
import random
import re
from collections import Counter

import brute
import test_nearsets
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import components, decontaminate, licenses, linededup, packing, pii, queries, quality, repeats, simhash
from tidelog.llm.common import table


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 120)] + [(7, 7), (119, 118), (118, 119)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 120), 100)}


def test_links_are_exact_with_and_without_hot_buckets(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 20)
    prints = {int(b) for b in base}
    for b in base[:6]:  # dense groups and chains around a few values
        for _ in range(60):
            prints.add(int(b) ^ sum({1 << int(i) for i in rng.integers(0, 64, rng.integers(1, 5))}))
    prints = sorted(simhash._signed(p & (1 << 64) - 1) for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = brute.components([(p, p & (1 << 64) - 1) for p in prints])
    for bucket_rows in (4096, 8):
        links = simhash.near_links(df, bucket_rows)
        got = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
        assert {p: got.get(p, p) for p in prints} == {p: want[p & (1 << 64) - 1] for p in prints}


def test_bit_sliced_comparison():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 20, 300).astype(np.uint64)
    values[1::3] = values[:-1:3] ^ np.uint64(5)
    planes = [simhash._plane((values >> np.uint64(b)) & np.uint64(1) == 1) for b in range(64)]
    for shift in (1, 2, 3):
        near = np.bitwise_count(values[:-shift] ^ values[shift:]) <= 2
        assert simhash._lanes(simhash.within_two(planes, shift, (1 << 300 - shift) - 1), 300).tolist() == np.flatnonzero(near).tolist()


def state(index):
    counts = {bytes(r["key"]): (r["n_docs"], r["keeper"]) for r in index.counts.collect()}
    postings = {(bytes(r["key"]), r["doc_id"]) for r in index.postings.collect()}
    filters = [linededup.Cuckoo(bytes(r["filter"])) for r in index.filters.collect()]
    return counts, postings, filters


def test_line_index_is_reversible(spark, edge):
    docs = edge.where("doc_id is not null")
    first, second = docs.where("doc_id <= 6"), docs.where("doc_id > 6")
    empty = linededup.empty_index(spark, 3)
    whole = linededup.insert(empty, docs)
    steps = linededup.insert(linededup.insert(empty, first), second)
    assert state(whole)[:2] == state(steps)[:2]
    back = linededup.delete(steps, second.select("doc_id"))
    once = linededup.insert(empty, first)
    assert state(back)[:2] == state(once)[:2]
    keys = set(state(once)[0])
    gone = set(state(whole)[0]) - keys
    assert all(any(k in f for f in state(back)[2]) for k in keys) and not any(k in f for f in state(back)[2] for k in gone)
    assert state(linededup.insert(whole, first))[:2] == state(whole)[:2]


def test_filters_decide_which_keys_meet_the_exact_tables(spark, sf, monkeypatch):
    """With filters only repeated keys are looked up; without them all are; the index and what it drops are the same."""
    docs = table(spark, sf, "documents")
    with_, without = (linededup.build(docs, use_filters=on) for on in (True, False))
    assert state(with_)[:2] == state(without)[:2]
    asked = [sum(counts.where("known").count() for _, counts in i.segments) for i in (with_, without)]
    repeated = linededup._all([c for _, c in with_.segments]).groupBy("shard", "key").count().where("count > 1").count()
    every = sum(counts.count() for _, counts in with_.segments)
    assert 0 < repeated <= asked[0] < 0.5 * asked[1] and asked[1] == every
    drops = [{r["doc_id"]: {bytes(k) for k in r["drop"]} for r in linededup.to_drop(i).collect()} for i in (with_, without)]
    assert drops[0] == drops[1] and drops[0]
    plain = linededup.Cuckoo.__contains__
    monkeypatch.setattr(linededup, "SHARD_KEYS", 20)
    many = linededup.insert(linededup.empty_index(spark, 1), docs)
    assert many.shards > 1 and {k: v for k, v in state(many)[0].items()} == state(with_)[0]
    assert max(len(t.tables) for t in state(many)[2]) <= 2 and plain is linededup.Cuckoo.__contains__


def test_a_filter_that_errs_changes_nothing(spark, edge):
    """Filters of one bucket report almost every key: inserting, deleting and what is dropped stay exact."""
    docs = edge.where("doc_id is not null")
    first, second = docs.where("doc_id <= 6"), docs.where("doc_id > 6")
    marks = {bytes([i]) * 16 for i in range(1, 200)}
    held = linededup.Cuckoo(b"", 16)
    for k in marks:
        held.add(k)
    blob = spark.createDataFrame([(s, held.blob()) for s in range(3)], linededup.FILTERS)
    start = linededup.LineIndex(3, linededup.empty_index(spark, 3).segments, blob)
    index = linededup.insert(linededup.insert(start, first), second)
    want = linededup.insert(linededup.empty_index(spark, 3), docs)
    assert state(index)[:2] == state(want)[:2]
    back = linededup.delete(index, second.select("doc_id"))
    assert state(linededup.insert(back, second))[:2] == state(want)[:2]


def test_cuckoo_grows_and_forgets():
    keys = [random.Random(i).randbytes(16) for i in range(4000)]
    f = linededup.Cuckoo()
    for k in keys:
        f.add(k)
    again = linededup.Cuckoo(f.blob())
    assert len(f.tables) > 1 and all(k in again for k in keys)
    for k in keys[:2000]:
        again.remove(k)
    assert all(k in again for k in keys[2000:]) and sum(k in again for k in keys[:2000]) < 20


def test_packing_little_padding_and_ranks_in_slices(spark):
    rng = np.random.default_rng(1)
    lengths = dict(zip(*(x.tolist() for x in np.unique(rng.integers(1, 2049, 20_000), return_counts=True))))
    patterns = packing.pack_histogram(lengths)
    held = {}
    for packs, items in patterns:
        assert sum(n * c for n, c in items.items()) <= 2048
        for n, c in items.items():
            held[n] = held.get(n, 0) + packs * c
    assert held == lengths and len(patterns) <= 3 * 2048
    assert sum(n * c for n, c in lengths.items()) / (2048 * sum(p for p, _ in patterns)) > 0.98
    rows = [(i, "a b") for i in range(500)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=8, slice_rows=7).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == 500 and len({r["sequence_id"] for r in out}) == 250


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b", "a \n b\n\nc  ", "x<|endoftext|>y", "é  ü  z", "a　 b", "don't  'll",
                                  "one two,\nthree. four", "a\xa0b c", "\n\n a", "tab\t x \t y", "1 2  3", "x,\ny z"])
def test_tokens_equal_the_library(text):
    (_, ids), = brute.token_pieces([(1, text)])
    assert packing.tokenizer("byte_bpe_50k").ids(text) == ids[:-1].tobytes()


def test_repeats_by_either_path(spark):
    rng = random.Random(3)

    def noise(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    passage, other = noise(900), noise(420)
    docs = [(i, noise(300) + passage[:rng.randint(380, 900)] + noise(200)) for i in range(12)]
    docs += [(20 + i, noise(50) + other + noise(50)) for i in range(5)] + [(30, "ab" * 700), (31, passage), (31, passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(brute.repeats(docs))
    for shard_units in (4096, 2):
        found = repeats.find(df, shard_units=shard_units)
        got = found.select("id", repeats.cut_digest("text", "found").alias("c")).select("id", "c.*").collect()
        assert sorted(tuple(r) for r in got) == want
    kept = repeats.remove(df).where("doc_id = 31").first()
    assert bytes(kept["kept"]) == b"" and [(s["start"], s["stop"]) for s in kept["spans"]] == [(0, 900)]


def test_shared_passages_of_fewer_bytes(spark):
    """Runs of 51 words that other rows have too, far below 400 bytes, at any place and in any surroundings."""
    rng = random.Random(5)

    def noise(n):
        return " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(n))

    passage, short, own = noise(60), noise(50), noise(70)
    docs = [(i, f"{noise(rng.randint(0, 40))}\n{passage}\t{noise(rng.randint(0, 40))}") for i in range(8)]
    docs += [(10 + i, f"{noise(5)} {short} {noise(5)}") for i in range(3)]  # 50 words
    docs += [(20, f"{own} {noise(3)} {own}"), (21, noise(200)), (22, None), (23, "")]  # twice in one document only
    docs += [(30 + i, " ".join(["ab"] * n)) for i, n in enumerate((50, 51, 300))]
    docs += [(40, noise(80))] * 2 + [(None, f"{noise(9)} {noise(1)}{passage}"), (41, passage[:200])]
    docs += [(50, f"{(x := noise(75))} {noise(2)} {x[:-1]}"), (51, f"{noise(4)} {x}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter(tuple(r) for r in repeats.op10(df).select("doc_id", "n_shared_words", "n_removed").collect())
    want = Counter((d, n, r[2]) for (d, n), r in zip(brute.shared_words(docs), brute.repeats(docs), strict=True))
    assert got == want
    assert all(n >= 60 and not removed for d, n, removed in got if d in range(8))
    assert got[20, 0, 0] == got[10, 0, 0] == got[21, 0, 0] == 1
    for words in (8, 20):
        found = repeats.shared(df, words=words).select("id", repeats.shared_words("text", "shared").alias("n"))
        assert Counter(tuple(r) for r in found.collect()) == Counter(brute.shared_words(docs, words))
    with pytest.raises(ValueError, match="words"):
        repeats.shared(df, words=7)


def test_words_of_long_texts(monkeypatch):
    """Texts longer than a chunk give the same words and units as in one piece."""
    raw = " ".join(f"w{i * i % 97}" for i in range(3000)).encode()
    batch = pa.RecordBatch.from_pydict({"d": [1], "row": [0], "text": [raw.decode()]})
    starts, numbers = repeats.word_numbers(raw)
    monkeypatch.setattr(repeats, "CHUNK", 700)
    cut = repeats.word_numbers(raw)
    assert (cut[0] == starts).all() and (cut[1] == numbers).all() and len(starts) == 3000
    covered = np.zeros(3000 - 50, dtype=int)
    for found in repeats._word_units(iter([batch]), 51):
        for place in found.column(2).to_pylist():
            start, windows, _, mark = repeats.unpacked(place)
            assert mark == repeats.check(raw)
            covered[start:start + windows] += 1
    assert (covered == 1).all()


def test_maximal_repeats_by_definition():
    rng = random.Random(1)
    for _ in range(100):
        least = 5
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(least, 25))) for _ in range(rng.randint(1, 4))]
        suffixes = sorted((t[a:], i, a) for i, t in enumerate(texts) for a in range(len(t) - least + 1))
        got = {(suffixes[f][0][:n], tuple(sorted((i, a) for _, i, a in suffixes[f:e])))
               for n, f, e in repeats.maximal_repeats(texts, suffixes, least)}
        places = {}
        for i, t in enumerate(texts):
            for a in range(len(t)):
                for b in range(a + least, len(t) + 1):
                    places.setdefault(t[a:b], []).append((i, a))
        want = set()
        for w, at in places.items():
            left = {texts[i][a - 1] if a else (i, "start") for i, a in at}
            right = {texts[i][a + len(w)] if a + len(w) < len(texts[i]) else (i, a) for i, a in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((w, tuple(sorted(at))))
        assert got == want


def brute_terms(docs, reach, generalise, remove):
    """(entity, term) -> (disclosure, action), by counting documents one by one."""
    total, held, both, having = max(2, len(docs)), Counter(), Counter(), Counter()
    for _, text in docs:
        text = text or ""
        spans = brute.base_pii(text)
        words = [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        having.update({w[0] for w in words})
        names, pairs = set(), set()
        for kind, a, b in spans:
            value = text[a:b].lower()
            digits = "".join(c for c in value if c in "0123456789")
            own = {"email": [value, "@" + value.split("@")[-1]], "ip": [value, value[:value.rindex(".") + 1] if "." in value else ""],
                   "card": [digits, digits[:6] + "-"], "phone": [digits, digits[:4] + "-"]}[kind]
            names |= {f"{kind}:{x}" for x in own}
            left = sum(w[1] < a for w in words)
            right = sum(w[1] < b for w in words)
            for i, (w, s, e) in enumerate(words):
                if left - reach <= i < right + reach and not any(s < y and e > x for _, x, y in spans):
                    pairs |= {(f"{kind}:{x}", w) for x in own}
        held.update(names)
        both.update(pairs)
    out = {}
    for (e, t), n in both.items():
        m, content = min(held[e], having[t]), math.log(total / held[e])
        if content > 0:
            told = n / (n + 1) * m / (m + 1) * (1 + math.log(n / having[t]) / content)
            if told >= generalise:
                out[e, t] = (round(told, 9), "remove" if told >= remove else "generalise")
    return out


@pytest.mark.parametrize("source", ["table", "edge", "made"])
def test_disclosure_is_that_of_counted_documents(spark, sf, edge, source):
    """PMI over IC, discounted, for all pairs of an entity and a term near it; spans stand wherever a telling term stands."""
    rng = random.Random(6)
    made = [(i, " ".join(rng.choice(["kim", "lee", "ann", "oak", "elm", "x@mail.org", "y@mail.org", "10.0.0.7", "10.0.0.9"])
                         for _ in range(rng.randint(0, 12)))) for i in range(60)]
    df = {"table": table(spark, sf, "documents"), "edge": edge, "made": spark.createDataFrame(made, "doc_id long, text string")}[source]
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    options = {"reach": 4, "generalise": 0.2, "remove": 0.4}
    want = brute_terms(docs, 4, 0.2, 0.4)
    plain = df.select("doc_id", pii.text_of("text").alias("text"))
    scanned = pii.stash(plain.mapInArrow(pii._scan, pii.SCANNED))
    got = {(r["entity"], r["term"]): (round(r["disclosure"], 9), r["action"]) for r in pii.disclosing(plain.select("text"), scanned, **options).collect()}
    assert got == want and (want or source == "edge")
    strict = {}
    for (_, t), (_, act) in want.items():
        strict[t] = max(strict.get(t, ""), act)  # remove is the later word
    for r in pii.found_in(df, **options).select("print", "places").distinct().collect():
        text = next(t or "" for _, t in docs if hashlib.md5((t or "").encode()).hexdigest() == r["print"])
        terms = {(p["start"], p["end"], p["action"] == "remove") for p in r["places"] if p["kind"] == 4}
        spans = brute.base_pii(text)
        assert terms == {(*m.span(), strict[m[0].lower()] == "remove") for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
                         if m[0].lower() in strict and not any(m.start() < y and m.end() > x for _, x, y in spans)}


def test_terms_that_give_an_entity_away(spark):
    rng = random.Random(2)
    fill = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "theta"]

    def noise(n=8):
        return " ".join(rng.choice(fill) for _ in range(n))

    docs = [(i, f"{noise()} kingfisher {noise()} jane.doe@example.com {noise()}") for i in range(14)]
    docs += [(None, f"{noise()} harbour bob@example.org {noise()}") for i in range(4)]
    docs += [(100 + i, noise(20)) for i in range(200)]
    docs += [(300, "the Kingfisher sings"), (300, None), (None, "harbour kingfisher")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = [(r["doc_id"], r["spans"], r["actions"]) for r in pii.find(df).collect()]
    assert len(rows) == len(docs) and (300, "term:4:14", "remove:4:14") in rows and (300, "", "") in rows
    assert (None, "term:0:7,term:8:18", "email:0:7,remove:8:18") in rows
    assert all(spans == "" for i, spans, _ in rows if i is not None and 100 <= i < 300)
    clean = sorted(r["text"] for r in pii.sanitise(df).collect())
    assert len(clean) == len(docs) and not any(x in t.lower() for t in clean for x in ("kingfisher", "harbour", "jane", "bob"))
    assert "the sings" in clean and "[email term]" in clean and sum("[email]" in t for t in clean) == 18


def test_pii_spans_of_hard_texts():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("a1.@-+ ()9é4") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute.base_pii(text)
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_license_rules(spark):
    known = licenses.rules()
    assert len(known) > 200 and all(any(g in k or g in p for g in licenses.gates(known)) for k, p, *_ in known)
    texts = ["Licensed under the GNU Affero General Public License, version 3 or (at your option) any later version.",
             "MIT License / cc-by-sa 4.0", "SPDX-License-Identifier: Apache-2.0", "cc by, cc by; apache license",
             "the 3-clause BSD license", "no licence here", "mitlicense cc bye"]
    out = licenses.op9(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    got = [r["labels"] for r in out.orderBy("doc_id").collect()]
    assert got == ["agpl-3.0-or-later", "cc-by,cc-by-sa-4.0,mit", "apache-2.0", "apache,cc-by", "bsd-3-clause", "", ""]


def test_pipeline_stages_take_effect(spark, sf):
    """Every stage does its own operator's work on what the stage before kept."""
    docs, kept = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stash(stage(spark, docs, sf))
        kept.append((name, docs))
    by = dict(kept)
    cols = table(spark, sf, "documents").columns
    assert all(df.columns == cols for name, df in kept[:4])
    judged = {r["doc_id"] for r in quality.op2(table(spark, sf, "documents"), table(spark, sf, "labels")).where("kept").collect()}
    assert judged == {r["doc_id"] for r in by["quality"].collect()}
    before = [(r["doc_id"], r["text"]) for r in by["quality"].collect()]
    lines = {d: h for d, _, _, h in brute.line_dedup(before)}
    after = {r["doc_id"]: r["text"] for r in by["line_dedup"].collect()}
    assert {d: brute.hashlib.sha256(t.encode()).hexdigest() for d, t in after.items()} == lines
    ids = sorted(after)
    assert {r["doc_id"] for r in by["near_dedup"].collect()} == {ids[g] for g in test_nearsets.groups([after[d] for d in ids])}
    items = [r["text"] for r in table(spark, sf, "benchmark").collect()]
    clean = {r["doc_id"]: r["text"] for r in by["decontamination"].collect()}
    dropped = {r["doc_id"] for r in by["near_dedup"].collect()} - set(clean)
    assert not any(i in t for t in clean.values() for i in items)
    finder = decontaminate.Finder([u for i, t in enumerate(items) for u in decontaminate.units(i, t)])
    assert all(finder.find(after[d]) for d in dropped)
    tokens = {d: len(x) for d, x in brute.token_pieces(list(clean.items()))}
    got = by["packing"].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == tokens
    assert queries.QUERIES["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None


def test_repeats_of_rows_that_share_an_id(spark):
    """Many texts under one id and under none: every row loses its own bytes only."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdef ") for _ in range(500))
    texts = ["".join(rng.choice("ghijkl ") for _ in range(rng.randint(0, 900))) for _ in range(60)]
    rows = [(1, t + passage if i % 3 == 0 else t) for i, t in enumerate(texts)] + [(None, passage + t) for t in texts[:5]] + [(2, None), (1, texts[0])]
    df = spark.createDataFrame(rows + rows[-1:], "doc_id long, text string")
    got = Counter(tuple(r) for r in repeats.op10(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == Counter(brute.repeats(rows + rows[-1:]))
    with pytest.raises(ValueError, match="length"):
        repeats.find(df, length=600)


def test_term_counts_do_not_follow_the_wanted_terms(spark):
    """A task tells of its own words once, whatever else the corpus holds: rows double with the texts, not with terms times tasks."""
    def told(n):
        texts = [(f"{' '.join(f'w{i * 5 + j}' for j in range(5))} common Common",) for i in range(n)]
        rows = pii._term_docs(spark.createDataFrame(texts, "text string").repartition(max(1, n // 20))).collect()
        sums = {}
        for r in rows:
            sums[r["term"]] = sums.get(r["term"], 0) + r["n"]
        assert sums == {"common": n, **{f"w{i}": 1 for i in range(5 * n)}}
        return len(rows)

    few, many = told(40), told(80)
    assert many == 2 * few
