"""The ten queries' contracts against plain versions, on the small table and on edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import (codesearch, decontaminate, langid, licenses, linededup, packing, pii, quality, queries, repeats,
                         simhash)
from tidelog.llm.common import table


@pytest.fixture(scope="module", params=["table", "edge"])
def docs(request, spark, sf, edge):
    return table(spark, sf, "documents") if request.param == "table" else edge


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def test_simhash(docs):
    prints = [(d, brute.simhash(t)) for d, t in pairs(docs)]
    least = brute.components(prints)
    assert rows(simhash.op5(docs), "doc_id", "fingerprint", "component_id") == Counter(
        (d, f"{p:016x}", least[p]) for d, p in prints)


def test_line_dedup(docs):
    assert rows(linededup.op7(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == Counter(
        brute.line_dedup(pairs(docs)))


def test_repeats(docs):
    assert rows(repeats.op10(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(
        brute.repeats(pairs(docs)))


def test_shared_words(docs):
    assert rows(repeats.op10(docs), "doc_id", "n_shared_words") == Counter(brute.shared_words(pairs(docs)))


def test_base_pii(docs):
    want = Counter()
    for d, t in pairs(docs):
        spans = brute.base_pii(t)
        kinds = Counter(s[0] for s in spans)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want[d, *[kinds[k] for k in ("email", "ip", "card", "phone")], hashlib.sha256(text.encode()).hexdigest()] += 1
    got = pii.op6(docs)
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want


def test_base_licenses(docs):
    got = licenses.op9(docs)
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == Counter(
        (d, *brute.base_licenses(t)) for d, t in pairs(docs))
    for r in got.collect():
        assert 0 <= r["score"] <= 1 and {*r["base_labels"].split(",")} - {""} <= {*r["labels"].split(",")}


def test_packing_is_exact_and_gapless(docs):
    texts = brute.token_pieces(pairs(docs))
    copies = Counter(d for d, _ in texts)
    ids = dict(texts)
    seen, sequences = Counter(), defaultdict(list)
    for r in packing.op3(docs).collect():
        own = ids[r["doc_id"]]
        assert brute.crc(own[r["start"]:r["start"] + r["length"]]) == r["ids_crc32"] and r["doc_tokens"] == len(own)
        seen[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == Counter({d: len(own) * copies[d] for d, own in ids.items()})
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_empty_tables(spark, sf, nothing):
    items, labels = table(spark, sf, "benchmark"), table(spark, sf, "labels")
    vectors = table(spark, sf, "embeddings").limit(0)
    for out in (decontaminate.op1(nothing, items), quality.op2(nothing, labels), packing.op3(nothing), langid.op4(nothing),
                simhash.op5(nothing), pii.op6(nothing), linededup.op7(nothing), codesearch.op8(vectors),
                licenses.op9(nothing), repeats.op10(nothing)):
        assert out.collect() == []


def test_code_search_matches_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.sql(f"select query_id, rank, neighbor_id, distance from ({codesearch.SQL})").fetchall()
    assert rows(queries.op8_code_search(spark, sf), "query_id", "rank", "neighbor_id", "distance") == Counter(want)


def test_code_search_edges(spark):
    vec = [[1.0] * 8, [1.0] * 8, [1.0] * 7 + [-1.0], None, [-1.0] * 8]
    df = spark.createDataFrame(list(enumerate(vec)) + [(None, [1.0] * 8)], "vec_id long, embedding array<float>")
    got = codesearch.top_k(df, df.where("vec_id = 0"), k=10, bits=8).orderBy("rank").collect()
    assert [(r["neighbor_id"], r["distance"]) for r in got] == [(1, 0), (2, 1), (4, 8)]


def test_languages_on_held_out_documents(spark, sf, edge):
    docs = table(spark, sf, "documents")
    out = langid.op4(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 20 and np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.95
    by = {r["doc_id"]: r for r in langid.op4(edge).collect()}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3))
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "de", "und") for r in by.values())


def test_language_model_reads_unseen_words_as_grams():
    model = langid.Model(["a", "b"], [("a", 0, "known", 5), ("a", 2, "xy", 9), ("b", 2, "zy", 9)])
    assert model.predict("known")[0] == "a" and model.predict("xyxy")[0] == "a" and model.predict("zyzy")[0] == "b"
    assert model.predict("12 !")[0] == "und" and model.predict(None) == ("und", 0.0)


def test_quality_on_held_out_labels(spark, sf, edge):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    out = quality.op2(docs, labels.where(~held)).join(
        labels.where(held).select("doc_id", F.col("quality").alias("label")), "doc_id").collect()
    assert np.mean([r["kept"] == bool(r["label"]) for r in out]) > 0.95
    assert sum(r["kept"] for r in out if r["label"] == 1) >= 0.98 * sum(r["label"] == 1 for r in out)
    none = quality.op2(edge, labels.limit(0)).collect()
    assert len(none) == edge.count() and all(abs(r["evidence"] - 0.5) < 1e-9 for r in none)
    assert quality.keep_good(edge, labels, F.col("source"), F.col("lang")).columns == edge.columns


def test_decontamination_finds_edited_items_and_leaves_others(spark):
    rng = random.Random(5)
    words = ["tion", "the", "and", "ing", "er", "on", "ha", "st"]

    def prose(n):
        return " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(n))

    for _ in range(60):
        item = prose(rng.randint(6, 25))
        (_, plain, budget), = decontaminate.units(1, item)
        copy = list(plain)
        for _ in range(rng.randint(0, budget + 3)):
            copy[rng.randrange(len(copy))] = rng.choice("abcxyz")
        text = f"{prose(15)} {''.join(copy)} {prose(15)}"
        want = brute.edit_within(plain, decontaminate.normal(text))
        assert decontaminate.Finder([(1, plain, budget)]).find(text) == ({1: want} if want <= budget else {})
    items = spark.createDataFrame([(1, prose(20)), (2, None), (None, prose(20)), (3, "Short one"), (1, prose(2000)), (4, "--")],
                                  "item_id long, text string")
    held = items.where("item_id = 1").orderBy(F.length("text")).collect()
    half = held[1]["text"][:len(held[1]["text"]) // 2]
    docs = spark.createDataFrame([(1, held[0]["text"].upper(), 1), (2, None, 2), (3, "", 3), (4, prose(300), 4), (5, held[1]["text"], 5), (5, half, 5),
                                  (6, "a short, ONE here", 6), (7, "short ones", 7), (8, held[1]["text"], 8)], "doc_id long, text string, leaks int")
    got = sorted((r["doc_id"], r["item_ids"]) for r in decontaminate.op1(docs, items).collect())
    assert got == [(1, [1]), (2, []), (3, []), (4, []), (5, []), (5, [1]), (6, [3]), (7, []), (8, [1])]
    several = decontaminate.clean(docs, items, block_chars=100)
    assert sorted(r["doc_id"] for r in several.collect()) == [2, 3, 4, 5, 7] and several.columns == docs.columns
    whole, parts = (decontaminate.leaks(docs, items, block_chars=n, out="found") for n in (10**6, 100))
    assert parts.columns == whole.columns and rows(whole.withColumn("found", F.col("found").cast("string")), *whole.columns) == rows(
        parts.withColumn("found", F.col("found").cast("string")), *whole.columns)


def test_decontamination_of_whole_items(spark, sf):
    """All items in all documents against plain edit distances, long items and short ones among them."""
    rng = random.Random(7)
    docs = [r["text"] for r in table(spark, sf, "documents").where("length(text) between 300 and 1500").orderBy("doc_id").limit(8).collect()]
    items = [r["text"] for r in table(spark, sf, "benchmark").limit(3).collect()]
    items += [max(docs, key=len), "of the", docs[5][:120]]
    docs += [f"{rng.choice(docs)} {i} end" for i in items]
    units = [u for n, i in enumerate(items) for u in decontaminate.units(n, i)]
    finder = decontaminate.Finder(units)
    for text in docs:
        plain, want = decontaminate.normal(text), {}
        for n, unit, budget in units:
            if len(unit) < decontaminate.LEAST_CHARS:
                if f" {unit} " in f" {plain} ":
                    want[n] = 0
            elif len(unit) <= len(plain) + budget and (d := brute.edit_within(unit, plain)) <= budget:
                want[n] = d
        assert finder.find(text) == want
