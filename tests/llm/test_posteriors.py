"""Quality posteriors and language scores against plain versions."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidelog.llm import langid, quality
from tidelog.llm.common import table


def strength(groups):
    """(n, s, prior mean) of groups -> prior weight by the method of moments."""
    total, squares = sum(n for n, _, _ in groups), sum(n * n for n, _, _ in groups)
    noise = sum(m * (1 - m) for _, _, m in groups)
    spread = sum(n * (s / n - m) ** 2 for n, s, m in groups)
    between = (spread - noise) / max(1e-9, total - squares / total)
    if between <= 0:
        return 10_000.0
    return min(max(sum(n * m * (1 - m) for n, _, m in groups) / total / between - 1, 1.0), 10_000.0)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_quality_is_the_posterior_of_its_groups(spark, folder):
    """From each row's evidence: shrunken site and path rates without the row itself, and the posterior."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = {r["doc_id"]: r for r in quality.op2(docs, labels).collect()}
    places = {r["doc_id"]: (r["source"], r["lang"]) for r in docs.collect()}
    told = [r["quality"] for r in labels.collect() if r["quality"] is not None and r["doc_id"] in places]
    own = {d: r["evidence"] for d, r in found.items()}
    sites, paths = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for d, (site, path) in places.items():
        for group in (sites[site], paths[site, path]):
            group[0] += 1
            group[1] += own[d]
    overall = sum(own.values()) / len(own)
    outer = strength([(n, s, overall) for n, s in sites.values()])
    rate = {k: (s + outer * overall) / (n + outer) for k, (n, s) in sites.items()}
    inner = strength([(n, s, rate[k[0]]) for k, (n, s) in paths.items()])
    share = sum(told) / len(told)
    for d, (site, path) in places.items():
        site_rate = (sites[site][1] - own[d] + outer * overall) / (sites[site][0] - 1 + outer)
        path_rate = (paths[site, path][1] - own[d] + inner * site_rate) / (paths[site, path][0] - 1 + inner)
        path_rate = min(max(path_rate, 0.02), 0.98)
        e = min(max(own[d], 1e-9), 1 - 1e-9)
        logit = math.log(e / (1 - e)) - math.log(share / (1 - share)) + math.log(path_rate / (1 - path_rate))
        want = 1 / (1 + math.exp(-logit))
        assert abs(found[d]["site_rate"] - site_rate) < 1e-6 and abs(found[d]["path_rate"] - path_rate) < 1e-6
        assert abs(found[d]["quality"] - want) < 1e-4 and found[d]["kept"] == (found[d]["quality"] >= 0.5)


def test_contradicting_labels_have_a_defined_result(spark, edge):
    """The majority of an id's labels holds, a tie counts as bad; order and repetition of rows change nothing."""
    shaped = spark.createDataFrame([(i, [float(i % 2)] + [0.0] * (len(quality.NAMES) - 1)) for i in range(40)], "id long, shape array<double>")
    plain = [(i, i % 2) for i in range(40)]
    noisy = plain + plain + [(i, 1 - i % 2) for i in range(0, 40, 3)] + [(50, 1), (None, 1), (3, None)] + [(2, 1), (2, 1)] + [(4, 1)]
    noisy += [(2, 0), (2, 0)]  # 2 is bad by majority again; 4 is a tie of two and two
    noisy += [(4, 1)]
    a = quality.fit(shaped, spark.createDataFrame(plain, "id long, quality int"), "id")
    b = quality.fit(shaped, spark.createDataFrame(noisy[::-1], "id long, quality int"), "id")
    assert a[2] == b[2] == 0.5 and all(abs(x - y) < 1e-6 for x, y in zip(a[0], b[0], strict=True))


def brute_scores(rows, texts):
    """(lang, text) samples and texts -> (language, score) by counting words and n-grams outright."""
    counts = defaultdict(lambda: defaultdict(Counter))  # size -> token -> lang -> n
    langs = sorted({lang for lang, text in rows if langid.LETTERS.findall(text.lower())})
    for lang, text in rows:
        for word in langid.LETTERS.findall(text.lower()):
            counts[0][word][lang] += 1
            for size in range(1, 5):
                marked = f"<{word}>" if size > 1 else word
                for i in range(len(marked) - size + 1):
                    counts[size][marked[i:i + size]][lang] += 1
    totals = {s: {lang: 1 + sum(c[lang] for c in counts[s].values()) for lang in langs} for s in range(5)}

    def log(size, token, lang):
        return math.log((counts[size][token][lang] + 0.5) / (totals[size][lang] + 0.5 * len(counts[size]) + 1))

    def word_scores(word):
        if word in counts[0]:
            return [log(0, word, lang) for lang in langs]
        marked, parts = f"<{word}>", []
        for at in range(len(marked) - 1):
            for size in range(min(4, len(marked) - at), 0, -1):
                if marked[at:at + size] in counts[size]:
                    parts.append((size, marked[at:at + size]))
                    break
        return [sum(log(s, t, lang) for s, t in parts) / math.sqrt(len(parts) or 1) for lang in langs]

    out = []
    for text in texts:
        words = Counter(langid.LETTERS.findall((text or "").lower()))
        if not langs or not any(c.isalpha() for w in words for c in w):
            out.append(("und", 0.0))
            continue
        total = [0.0] * len(langs)
        for word, n in words.items():
            scores = word_scores(word)
            for i in range(len(langs)):
                total[i] += n * (scores[i] - max(scores))
        total = [t / max(1.0, sum(words.values()) / 20) for t in total]
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        out.append((langs[best], 1 / sum(math.exp(t - total[best]) for t in total)))
    return out


@pytest.mark.parametrize("source", ["table", "edge"])
def test_languages_are_those_of_counted_words_and_grams(spark, sf, edge, source):
    """Every document's language and score, from a model of all rows outside the held-out fold; ties go to the first language."""
    docs = table(spark, sf, "documents") if source == "table" else edge
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2
    rows = [(r["lang"], r["text"]) for r in docs.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect()]
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = Counter((d, lang, round(score, 6)) for (d, _), (lang, score) in zip(texts, brute_scores(rows, [t for _, t in texts]), strict=True))
    got = Counter((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in langid.op4(docs).collect())
    assert got == want
    assert brute_scores([("b", "x"), ("a", "x")], ["x", "?"]) == [("a", 0.5), ("und", 0.0)]
