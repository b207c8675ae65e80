"""Licence signatures in column expressions only.

Hundreds of ordered regular expressions, written for families of licences and
their versions, run over normalised words. A rule is tried only on texts that
hold its keyword. Detections carry a span in words; one that lies inside
another of the same or a better priority is dropped, and the rest give the
labels. No Python runs on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import stash, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, before and after A-Z become lower case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Fixed values of the contract: phrase and label.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: family, pattern of its name, keyword, label, versions
FAMILIES = [
    ("gnu general public licen[cs]e", "general public", "gpl", ("1.0", "2.0", "3.0")),
    ("gnu lesser general public licen[cs]e", "lesser general", "lgpl", ("2.0", "2.1", "3.0")),
    ("gnu library general public licen[cs]e", "library general", "lgpl", ("2.0",)),
    ("gnu affero general public licen[cs]e", "affero general", "agpl", ("1.0", "3.0")),
    ("gnu free documentation licen[cs]e", "free documentation", "gfdl", ("1.1", "1.2", "1.3")),
    ("apache (?:software )?licen[cs]e", "apache", "apache", ("1.0", "1.1", "2.0")),
    ("mozilla public licen[cs]e", "mozilla public", "mpl", ("1.0", "1.1", "2.0")),
    ("eclipse public licen[cs]e", "eclipse public", "epl", ("1.0", "2.0")),
    ("eclipse distribution licen[cs]e", "eclipse distribution", "edl", ("1.0",)),
    ("common development and distribution licen[cs]e", "common development", "cddl", ("1.0", "1.1")),
    ("common public licen[cs]e", "common public", "cpl", ("1.0",)),
    ("european union public licen[cs]e", "european union public", "eupl", ("1.0", "1.1", "1.2")),
    ("artistic licen[cs]e", "artistic", "artistic", ("1.0", "2.0")),
    ("academic free licen[cs]e", "academic free", "afl", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("open software licen[cs]e", "open software", "osl", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("boost software licen[cs]e", "boost software", "bsl", ("1.0",)),
    ("server side public licen[cs]e", "server side", "sspl", ("1.0",)),
    ("business source licen[cs]e", "business source", "busl", ("1.0", "1.1")),
    ("sil open font licen[cs]e", "open font", "ofl", ("1.0", "1.1")),
    ("latex project public licen[cs]e", "latex project", "lppl", ("1.0", "1.1", "1.2", "1.3")),
    ("microsoft public licen[cs]e", "microsoft public", "ms-pl", ()),
    ("microsoft reciprocal licen[cs]e", "microsoft reciprocal", "ms-rl", ()),
    ("python software foundation licen[cs]e", "python software", "psf", ("2.0",)),
    ("php licen[cs]e", "php", "php", ("3.0", "3.01")),
    ("zope public licen[cs]e", "zope public", "zpl", ("1.1", "2.0", "2.1")),
    ("cecill(?: free software)? licen[cs]e", "cecill", "cecill", ("1.0", "1.1", "2.0", "2.1")),
    ("open data commons open database licen[cs]e", "open database", "odbl", ("1.0",)),
    ("university of illinois ncsa open source licen[cs]e", "illinois", "ncsa", ()),
    ("mit licen[cs]e", "mit", "mit", ()),
    ("expat licen[cs]e", "expat", "mit", ()),
    ("isc licen[cs]e", "isc", "isc", ()),
    ("zlib(?: libpng)? licen[cs]e", "zlib", "zlib", ()),
    ("do what the fuck you want to public licen[cs]e", "want to public", "wtfpl", ("2.0",)),
    ("the unlicen[cs]e", "unlicen", "unlicense", ()),
]
SHORT_FORMS = ("gpl", "lgpl", "agpl", "apache", "eupl", "cddl")
CLAUSES = {"0": "zero", "1": "one", "2": "two", "3": "three", "4": "four"}
SHARING = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
SHARING_NAMES = ("attribution", "attribution share ?alike", "attribution no ?deriv(?:ative)?s",
                 "attribution non ?commercial", "attribution non ?commercial share ?alike",
                 "attribution non ?commercial no ?deriv(?:ative)?s")
#: Sentences that only stand in the text of a licence.
SENTENCES = [
    ("permission is hereby granted free of charge to any person obtaining a copy", "hereby granted", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose", "modify and or distribute", "isc"),
    ("redistribution and use in source and binary forms with or without modification are permitted",
     "source and binary forms", "bsd"),
    ("neither the name of .{1,80}? may be used to endorse or promote products", "endorse or promote", "bsd-3-clause"),
    ("everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document", "verbatim copies", "gpl"),
    ("you may not use this file except in compliance with the licen[cs]e", "except in compliance", "apache-2.0"),
    ("this source code form is subject to the terms of the mozilla public", "source code form", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unencumbered", "unlicense"),
    ("all rights reserved", "rights reserved", "proprietary"),
]

Rule = tuple[str, str, str, int, float]


def _version(version: str) -> str:
    """2.0 stands as "2 0" between words, and as "2"."""
    major, minor = version.split(".")
    return f"{major}(?: {minor})?" if minor == "0" else f"{major} {minor}"


def rules() -> list[Rule]:
    """(keyword, pattern, label, priority, score); priority 0 is the most specific. Patterns match whole words."""
    out: list[Rule] = []
    for name, keyword, label, versions in FAMILIES:
        for version in versions:
            stated = f"{name}(?: ver(?:sion)?| v)? {_version(version)}"
            if label in ("gpl", "lgpl", "agpl", "gfdl"):
                later = rf"{stated}(?: of the licen[cs]e)? or(?: at your option)?(?: any)? (?:later|newer)"
                out += [(keyword, later, f"{label}-{version}-or-later", 0, 1.0),
                        (keyword, f"{stated} only", f"{label}-{version}-only", 0, 1.0)]
            out.append((keyword, stated, f"{label}-{version}", 1, 0.95))
            short = label.replace("-", " ")
            out += [(f"identifier {short} {version.replace('.', ' ')}",
                     f"spdx licen[cs]e identifier {short} {version.replace('.', ' ')} or later",
                     f"{label}-{version}-or-later", 0, 1.0),
                    (f"identifier {short} {version.replace('.', ' ')}",
                     f"spdx licen[cs]e identifier {short} {version.replace('.', ' ')}(?: only)?", f"{label}-{version}", 0, 1.0)]
            if label in SHORT_FORMS:
                out.append((short, f"{short}(?: v)? ?{version.replace('.', ' ')}", f"{label}-{version}", 2, 0.7))
        out.append((keyword, name, label, 2, 0.8))
        out.append(("identifier " + label.replace("-", " "), f"spdx licen[cs]e identifier {label.replace('-', ' ')}",
                    label, 1, 0.95))
    for digit, word in CLAUSES.items():
        out += [("bsd", f"bsd {digit} clause(?: licen[cs]e)?", f"bsd-{digit}-clause", 1, 0.95),
                ("bsd", f"(?:{digit}|{word}) clause bsd(?: licen[cs]e)?", f"bsd-{digit}-clause", 1, 0.95),
                ("identifier bsd", f"spdx licen[cs]e identifier bsd {digit} clause", f"bsd-{digit}-clause", 0, 1.0)]
    out += [("bsd", "(?:new|modified|revised) bsd licen[cs]e", "bsd-3-clause", 1, 0.9),
            ("bsd", "(?:simplified|free) bsd licen[cs]e", "bsd-2-clause", 1, 0.9), ("bsd", "bsd licen[cs]e", "bsd", 2, 0.8)]
    for short, long in zip(SHARING, SHARING_NAMES, strict=True):
        label = "cc-" + short.replace(" ", "-")
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            stated = version.replace(".", " ")
            out += [("cc by", f"cc {short} {stated}", f"{label}-{version}", 0, 1.0),
                    ("creative commons", f"creative commons {long} {stated}", f"{label}-{version}", 0, 1.0)]
        out += [("cc by", f"cc {short}", label, 2, 0.8), ("creative commons", f"creative commons {long}", label, 1, 0.9),
                ("creativecommons", f"creativecommons org licen[cs]es {short}", label, 1, 0.9)]
    out += [("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0-1.0", 1, 0.9),
            ("public domain", "(?:released|placed) (?:in|into|to) the public domain", "public-domain", 2, 0.7)]
    out += [(keyword, pattern, label, 1, 0.9) for pattern, keyword, label in SENTENCES]
    return out


def _count_words(spaced: Column) -> Column:
    """Words of a piece of a spaced text: each has a blank on either side."""
    return F.floor((F.length(spaced) - F.length(F.replace(spaced, F.lit(" ")))) / 2).cast("long")


def _phrase(phrase: str) -> str:
    return " " + phrase.replace(" ", "  ") + " "


def _base(spaced: Column) -> dict[str, Column]:
    parts = {label: F.split(spaced, _phrase(phrase)) for phrase, label in BASE}
    size = {phrase: len(phrase.split()) for phrase, _ in BASE}
    found = {label: F.size(p) > 1 for label, p in parts.items()}
    first = [F.when(found[label], _count_words(parts[label][0])) for _, label in BASE]
    last = [F.when(found[label], _count_words(spaced) - _count_words(F.element_at(parts[label], -1)) - size[phrase])
            for phrase, label in BASE]
    labels = F.array_compact(F.array(*[F.when(found[label], F.lit(label)) for _, label in BASE]))
    return {"n_base": sum((F.size(parts[label]) - 1 for _, label in BASE), F.lit(0)).cast("long"),
            "first_word": F.least(*first), "last_word": F.greatest(*last), "base": F.array_sort(labels)}


def _words_in(text: Column) -> Column:
    """Words of a part of the single-blank text, whose every word is followed by a blank."""
    return (F.length(text) - F.length(F.replace(text, F.lit(" ")))).cast("long")


def gates(known: list[Rule]) -> list[str]:
    """Strings without blanks, one of which stands in every text that any rule matches."""
    strong = ["licen", "gpl", "apache"]
    found = {next((g for g in strong if g in keyword or g in pattern), max(keyword.split(), key=len))
             for keyword, pattern, *_ in known}
    return sorted(found | {max(phrase.split(), key=len) for phrase, _ in BASE if "licen" not in phrase})


def _matches(known: list[Rule]) -> Column:
    """For each rule whose keyword stands in ``plain``: words before each match (since the last one) and in it."""
    table = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(f" {rule[0]}").alias("keyword"),
                               F.lit(f"(?<= ){rule[1]} ").alias("pattern")) for i, rule in enumerate(known)])
    text = F.col("plain")
    active = F.filter(table, lambda r: F.contains(text, r["keyword"]))
    return F.transform(active, lambda r: F.struct(
        r["rule"].alias("rule"),
        F.arrays_zip(F.transform(F.split(text, r["pattern"], -1), _words_in).alias("gap"),
                     F.transform(F.regexp_extract_all(text, r["pattern"], F.lit(0)), _words_in).alias("size")).alias("at")))


def detections(prepared: DataFrame, known: list[Rule]) -> DataFrame:
    """(row, start, end, rule) of every match in the rows with a ``plain`` text, in words."""
    tried = prepared.where("plain is not null").select("row", F.explode(_matches(known)).alias("m")).where(
        F.size("m.at") > 1)
    each = tried.select("row", "m.rule", F.posexplode("m.at").alias("i", "at")).select(
        "row", "rule", "i", F.col("at.gap").alias("gap"), F.coalesce("at.size", F.lit(0)).alias("size"))
    past = Window.partitionBy("row", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(past)
    # the text starts with a blank, which the first gap counts
    return each.withColumn("end", end - 1).where("size > 0").select(
        "row", (F.col("end") - F.col("size")).alias("start"), "end", "rule")


def surviving(found: DataFrame, known: list[Rule]) -> DataFrame:
    """Detections that lie in no other one of the same or a better priority, with label, priority and score."""
    described = F.broadcast(found.sparkSession.createDataFrame(
        [(i, rule[2], rule[3], rule[4]) for i, rule in enumerate(known)],
        "rule int, label string, priority int, score double"))
    rows = found.join(described, "rule")
    order = [F.col("start"), F.desc("end"), F.col("priority"), F.col("rule")]
    before = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({rule[3] for rule in known})
    reach = rows.withColumns({f"_to{p}": F.max(F.when(F.col("priority") <= p, F.col("end"))).over(before) for p in levels})
    inside = F.lit(False)
    for p in levels:
        inside = inside | ((F.col("priority") == p) & F.coalesce(F.col(f"_to{p}") >= F.col("end"), F.lit(False)))
    return reach.where(~inside).select("row", "start", "end", "label", "priority", "score")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         known: list[Rule] | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row for each row of ``docs``, its detections (row, start, end, label, priority, score)).

    The first has row, doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score; ``row`` tells rows apart, whatever their ids.
    Null and empty texts have no word, no label and score 0. Other columns of
    ``docs`` are not read. Empty tables give empty tables.
    """
    known = rules() if known is None else known
    text = text_of(text_col)
    lowered = F.lower(text)
    gate = F.lit(False)
    for word in gates(known):
        gate = gate | F.contains(lowered, F.lit(word))
    prepared = stash(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        F.when(gate, F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAPS, " ")), F.lit(" "))
               ).alias("plain")))
    hits = stash(surviving(detections(prepared, known), known))
    per_row = hits.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    spaced = F.replace(F.col("plain"), F.lit(" "), F.lit("  "))
    base = prepared.where("plain is not null").select("row", F.substring(spaced, 2, 2147483647).alias("spaced")).select(
        "row", *[c.alias(n) for n, c in _base(F.col("spaced")).items()]).where("n_base > 0")
    nothing = F.array().cast("array<string>")
    joined = prepared.select("row", "doc_id", "n_words").join(base, "row", "left").join(per_row, "row", "left")
    own = F.coalesce("base", nothing)
    whole = F.array_sort(F.array_union(own, F.coalesce("found", nothing)))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.8).otherwise(0.0))
    result = joined.select("row", "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                           "first_word", "last_word", F.array_join(own, ",").alias("base_labels"),
                           F.array_join(whole, ",").alias("labels"), score.alias("score"))
    return result, hits


def op9(docs: DataFrame) -> DataFrame:
    return scan(docs)[0].drop("row")
