"""The near_dedup stage: five-word shingles, Jaccard 0.8 or more, one row of each group."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidelog.llm import nearsets


def words(text, width=5):
    own = (text or "").encode().lower().split()
    return {b" ".join(own[i:i + width]) for i in range(max(1, len(own) - width + 1))} if own else set()


def groups(texts):
    """row -> least row of its closure of Jaccard 0.8, by all pairs."""
    sets, parent = [words(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def corpus():
    """Copies with more and more changed words, chains of copies of copies, a passage that many texts hold, short and empty texts."""
    rng = random.Random(12)

    def prose(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]

    passage, texts = prose(60), ["", None, " \n", "one two", "One  two", "a b c d e", "a b c d e f"]
    for n in (30, 80, 300):
        base = prose(n)
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.04, 0.06):
            copy = list(base)
            for _ in range(max(1, int(share * n))):
                copy[rng.randrange(n)] = "changed"
            texts.append(" ".join(copy))
        chain = prose(n)
        for _ in range(8):
            texts.append(" ".join(chain))
            at = rng.randrange(n)
            chain = [*chain[:at], *prose(max(1, n // 60)), *chain[at + max(1, n // 60):]]
    return texts + [" ".join([*prose(20), *passage, *prose(rng.randint(1, 60))]) for _ in range(30)]


@pytest.mark.parametrize(("hot_rows", "crowd"), [(nearsets.HOT_ROWS, nearsets.CROWD), (0, 6)])
def test_groups_are_those_of_all_pairs(spark, hot_rows, crowd):
    """Also where frequent shingles are joined instead of sent, and where every frequent shingle is dealt out."""
    texts = corpus()
    want = groups(texts)
    assert 10 < len(set(want)) < len(texts) - 20
    df = nearsets.stash(spark.createDataFrame(list(enumerate(texts)), "row long, text string"))
    got = {r["row"]: r["group"] for r in nearsets.near_sets(df, hot_rows=hot_rows, crowd=crowd).collect()}
    least = {}
    for row in sorted(got):
        least.setdefault(got[row], row)
    assert [least[got[i]] for i in range(len(texts))] == want


def test_stage_drops_planted_near_copies(spark, sf):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, df, sf).collect()}
    assert got == {i for i, least in enumerate(groups(texts)) if i == least}
    assert corpus_pipeline.one_of_each(spark, df.limit(0), sf).collect() == []


def test_one_row_stays_where_ids_repeat_or_lack(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(1, base), (1, base), (None, base), (2, f"{base} end"), (None, "x y"), (None, "X  y"), (7, "other words"), (7, "quite another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = nearsets.keep_one(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 1, 7, 7]


def test_near_copies_of_many_variants(spark):
    """One text in many variants around the bound, a third of all rows: the pairs looked at stay few, and none is lost."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(f"o{i}x{j}" for j in range(40)) for i in range(160)]
    for _ in range(80):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    want = groups(texts)
    df = nearsets.stash(spark.createDataFrame(list(enumerate(texts)), "row long, text string"))
    got = {r["row"]: r["group"] for r in nearsets.near_sets(df).collect()}
    least = {}
    for row in sorted(got):
        least.setdefault(got[row], row)
    assert [least[got[i]] for i in range(len(texts))] == want


def test_tables_of_a_stage_go_with_it(spark, tmp_path):
    """A scope deletes what was written inside it but for what it was told to keep."""
    from tidelog.llm.common import scope, stash
    df = spark.range(5)
    with scope() as kept:
        gone, stays = stash(df), stash(df.withColumn("x", F.col("id")))
        kept.append(stays)
        path = gone.stash_path
    assert gone.stash_path is None and stays.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()


def test_the_stage_takes_simhash_pairs(spark, monkeypatch):
    """SimHash of the stage's own shingles proposes near texts; its pairs are among those the stage settles."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(2000)]
    texts = [" ".join(base), " ".join([*base[:-1], "changed"]), " ".join(f"v{i}" for i in range(2000))]
    width_3, width_5 = ([nearsets.simhash.fingerprint(t, w) for t in texts] for w in (3, 5))
    assert (width_5[0] ^ width_5[1]).bit_count() <= 2 < (width_5[0] ^ width_5[2]).bit_count() and width_3 != width_5
    seen, pairs = [], nearsets._simhash_pairs

    def watched(*args):
        out = pairs(*args)
        seen.append((out.collect(), {r["cid"]: r["row"] for r in args[1].collect()}))
        return out

    monkeypatch.setattr(nearsets, "_simhash_pairs", watched)
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = corpus_pipeline.one_of_each(spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == {1, 3}
    (found, row_of), = seen
    order = {r: i for i, r in enumerate(sorted(row_of.values()))}
    assert [{order[row_of[r["a"]]], order[row_of[r["b"]]]} for r in found] == [{0, 1}]
