"""Personal data: patterns find it, corpus co-occurrence finds the words that give it away.

Four kinds of values are found by pattern. Every value is a protected entity,
and so is the level that many values share: a mail domain, a network, a card
issuer, a dialling prefix. Words within ``REACH`` words of a value co-occur with
its entities, once a document. Naming a term t tells ``PMI(t; e) / IC(e)`` of
what naming e would tell: 1 + log p(e | t) / IC(e), with p(e | t) and IC(e) from
all documents. Few observations prove little, so this share is discounted by
both / (both + 1) times m / (m + 1), where ``both`` documents hold t beside e
and m is the smaller of all holders of e and all of t. There is no other floor:
entities and pairs are left out only where no count of t's documents could bring
them to the threshold. Terms at or above ``GENERALISE`` are generalised, at or above
``REMOVE`` removed, wherever they stand in any document.

Contexts are linear in the values, never a product of a document's terms and
entities. The documents of a term are counted in a pass for all words, its marks
in one that knows the wanted terms by a bit filter of fixed size; a join makes
both exact.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import ready, scope, stash, text_of

KINDS = ("email", "ip", "card", "phone", "term")
REACH = 50
GENERALISE = 0.44
REMOVE = 0.7
FLUSH = 400_000
FILTER_BITS = 24
ANY = "*"

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each @: its local part is the run before it, back to the last match at most."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return found


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def base_spans(text: str | None) -> list[Span]:
    """Spans of the four kinds by start, then kind; code points, end exclusive. A failing match is not retried."""
    text = text or ""
    found = emails(text) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if 12 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def entities(text: str, span: Span) -> list[str]:
    """A value's name (kind and lower-cased characters without separators) and the name of the level it shares with others."""
    kind, value = span[0], text[span[1]:span[2]].lower()
    if kind == "email":
        return [f"email:{value}", f"email:@{value.rpartition('@')[2]}"]
    if kind == "ip":
        return [f"ip:{value}", f"ip:{value.rpartition('.')[0]}."]
    digits = _digits(value)
    return [f"{kind}:{digits}", f"{kind}:{digits[:6 if kind == 'card' else 4]}-"]


def free_words(text: str, spans: list[Span]) -> list[tuple[str, int, int]]:
    """(word, start, end) of all words, lower-cased; the word is empty where a span covers part of it."""
    words = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]
    starts = [w[1] for w in words]
    for _, start, end in spans:
        i = max(0, bisect_left(starts, start) - 1)
        while i < len(words) and words[i][1] < end:
            if words[i][2] > start:
                words[i] = ("", *words[i][1:])
            i += 1
    return words


def contexts(text: str, spans: list[Span], reach: int = REACH) -> set[tuple[str, str]]:
    """(entity, term) for the terms within ``reach`` words of a value; words that a value covers are no terms."""
    words = free_words(text, spans)
    starts = [w[1] for w in words]
    out = set()
    for span in spans:
        left, right = bisect_left(starts, span[1]), bisect_left(starts, span[2])
        near = {w[0] for w in words[max(0, left - reach):right + reach]} - {""}
        out |= {(name, term) for name in entities(text, span) for term in near}
    return out


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> the document's own results and the names of its entities."""
    for rows in _parts(batches):
        texts = rows.column(1).to_pylist()
        results = [base_spans(t) for t in texts]
        counts = [Counter(kind for kind, _, _ in spans) for spans in results]
        lists = [written(spans) for spans in results]
        yield pa.RecordBatch.from_arrays(
            [rows.column(0).cast(pa.int64()), *[pa.array([c[k] for c in counts], pa.int64()) for k in KINDS[:4]],
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in lists]), pa.array(lists),
             pa.array([hashlib.md5(t.encode()).hexdigest() for t in texts]),
             pa.array([sorted({e for s in spans for e in entities(t, s)}) for t, spans in zip(texts, results, strict=True)],
                      pa.list_(pa.string()))],
            ["doc_id", *[f"n_{k}" for k in KINDS[:4]], "base_sha256", "base", "print", "entities"])


SCANNED = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
           "print string, entities array<string>")


def _place(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode(), 7) >> 64 - FILTER_BITS


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _parts(batches, 1 << 14):
        yield pa.RecordBatch.from_arrays([pa.array([_place(t) for t in rows.column(0).to_pylist()], pa.int64())], ["place"])


def _filter(names: DataFrame) -> bytes:
    """A bit for each place of a name (one column): fixed size, put together by aggregation."""
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    seen = np.zeros(1 << FILTER_BITS >> 6, dtype=np.int64)
    for r in ready(names).mapInArrow(_placed, "place long").groupBy(F.floor(F.col("place") / 64).alias("word")).agg(
            F.bit_or(bit).alias("bits")).collect():
        seen[r["word"]] = r["bits"]
    return seen.tobytes()


class Held:
    """Whether the filter may hold a name; answers are kept, since words repeat."""

    def __init__(self, bits: bytes) -> None:
        self.bits, self.known = bits, {}

    def __call__(self, name: str) -> bool:
        out = self.known.get(name)
        if out is None:
            place = _place(name)
            out = bool(self.bits[place >> 3] >> (place & 7) & 1)
            if len(self.known) > FLUSH:
                self.known.clear()
            self.known[name] = out
        return out


def _pairs(texts: DataFrame, wanted: bytes, reach: int) -> DataFrame:
    """(entity, term, both): in how many of a task's documents they co-occur, for entities the filter may hold.

    The entity ANY counts the documents in which a term is near any of them.
    """
    sent = texts.sparkSession.sparkContext.broadcast(wanted)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[tuple[str, str]] = Counter()
        held = Held(sent.value)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in sums], pa.string()) for i in (0, 1)),
                                               pa.array(sums.values(), pa.int64())], ["entity", "term", "both"])

        for rows in _parts(batches):
            for text in rows.column(0).to_pylist():
                spans = base_spans(text)
                if any(held(e) for s in spans for e in entities(text, s)):
                    near = {c for c in contexts(text, spans, reach) if held(c[0])}
                    sums.update(near)
                    sums.update({(ANY, term) for _, term in near})
            if len(sums) > FLUSH:
                yield told()
                sums.clear()
        yield told()

    return texts.mapInArrow(paired, "entity string, term string, both long")


def _term_docs(texts: DataFrame) -> DataFrame:
    """(term, n): in how many of a task's documents a term stands, for all terms.

    A task tells of its own words, so the rows grow with the texts. Told only for
    wanted terms they would grow with tasks times terms, which both grow.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), pa.array(sums.values(), pa.int64())],
                                              ["term", "n"])

        for rows in _parts(batches):
            for text in rows.column(0).to_pylist():
                sums.update(set(WORD.findall(text.lower())))
            if len(sums) > FLUSH:
                yield told()
                sums.clear()
        yield told()

    return texts.mapInArrow(counted, "term string, n long")


def _marks(texts: DataFrame, wanted: bytes) -> DataFrame:
    """(print, places): for each text that holds them, the places (term, start, end) of terms the filter may hold, outside values."""
    sent = texts.sparkSession.sparkContext.broadcast(wanted)
    kind = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(sent.value)
        for rows in _parts(batches, 128):
            prints, places = [], []
            for text in rows.column(0).to_pylist():
                hits = {t for t in set(WORD.findall(text.lower())) if held(t)}
                if not hits:
                    continue
                found = [(w, *m.span()) for m in WORD.finditer(text) if (w := m.group().lower()) in hits]
                spans = base_spans(text)
                if spans:
                    found = [f for f in found if not any(f[1] < end and f[2] > start for _, start, end in spans)]
                if found:
                    prints.append(hashlib.md5(text.encode()).hexdigest())
                    places.append([dict(zip(("term", "start", "end"), f, strict=True)) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.string()), pa.array(places, kind)], ["print", "places"])

    return texts.mapInArrow(marked, "print string, places array<struct<term:string,start:bigint,end:bigint>>")


def disclosing(texts: DataFrame, scanned: DataFrame, reach: int = REACH, generalise: float = GENERALISE,
               remove: float = REMOVE) -> DataFrame:
    """(entity, term, disclosure, action), written: the terms that give an entity away."""
    total = float(max(scanned.count(), 2))
    found = scanned.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("holders"))
    # both and m are at most the holders: below this many, no term can reach the threshold
    found = stash(found.where((F.col("holders") / (F.col("holders") + 1)) ** 2 >= generalise))
    pairs = _pairs(texts, _filter(found.select("entity")), reach).groupBy("entity", "term").agg(F.sum("both").alias("both"))
    pairs = stash(pairs)
    content = F.log(F.lit(total) / F.col("holders"))

    def most(least_docs: Column) -> Column:
        """The most a pair can reach with at least so many documents of its term: past IC more than that, more only lower it."""
        docs = F.sequence(least_docs, F.greatest(least_docs, F.least(F.col("holders"), least_docs + 60)))
        share = F.array_max(F.transform(docs, lambda d: F.least(d, F.col("holders")) / (F.least(d, F.col("holders")) + 1) * (
            1 - F.log(d / F.col("both")) / content)))
        return F.when(content > 0, F.col("both") / (F.col("both") + 1) * share)

    near = pairs.where(F.col("entity") == ANY).select("term", F.col("both").alias("near"))
    joint = stash(pairs.where(F.col("entity") != ANY).join(found, "entity").where(most(F.col("both")) >= generalise - 1e-12))
    # a term has at least the documents in which it stands near any entity
    joint = stash(joint.join(near, "term").where(most(F.greatest("both", "near")) >= generalise - 1e-12).drop("near"))
    docs = _term_docs(texts).groupBy("term").agg(F.sum("n").alias("docs"))
    least = F.least("holders", "docs")
    trust = F.col("both") / (F.col("both") + 1) * least / (least + 1)
    share = F.when(content > 0, trust * (1 + F.log(F.col("both") / F.col("docs")) / content))
    return stash(joint.join(docs, "term").select("entity", "term", share.alias("disclosure")).where(
        F.col("disclosure") >= generalise).withColumn(
        "action", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")))


PLACES = "array<struct<start:bigint,kind:int,end:bigint,action:string>>"


def marked_texts(texts: DataFrame, scanned: DataFrame, **options) -> DataFrame:
    """(print, terms), written: the places of disclosing terms in each different text that holds one.

    A term's action is the strictest it has for any entity; a generalised term
    becomes the kind of the entity that it tells most about.
    """
    telling = disclosing(texts, scanned, **options)
    best = F.max(F.struct("disclosure", F.split("entity", ":")[0].alias("kind"), "action")).alias("best")
    terms = stash(telling.groupBy("term").agg(best).select("term", F.when(
        F.col("best.action") == "remove", "remove").otherwise(F.col("best.kind")).alias("action")))
    # copies of a text have the same places: one of them is joined
    once = _marks(texts, _filter(terms.select("term"))).dropDuplicates(["print"])
    places = once.select("print", F.explode("places").alias("at")).select("print", "at.*").join(terms, "term")
    return stash(places.groupBy("print").agg(F.array_sort(F.collect_set(F.struct(
        "start", F.lit(4).alias("kind"), "end", "action"))).alias("terms")))


def found_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, counts, base_sha256, base, print, spans of all kinds with the terms' actions) for each row of ``docs``."""
    with scope() as kept:
        plain = ready(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
        scanned = stash(plain.mapInArrow(_scan, SCANNED))
        terms = marked_texts(plain.select("text"), scanned, **options)
        kept += [scanned, terms]
    kinds = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(
        F.split(s, ":")[1].cast("long").alias("start"),
        (F.array_position(kinds, F.split(s, ":")[0]) - 1).cast("int").alias("kind"),
        F.split(s, ":")[2].cast("long").alias("end"), F.lit(None).cast("string").alias("action")))
    every = F.array_sort(F.concat(base, F.coalesce("terms", F.array().cast(PLACES))))
    return scanned.join(terms, "print", "left").select(
        "doc_id", *[f"n_{k}" for k in KINDS[:4]], "base_sha256", "base", "print", every.alias("places"))


def _listed(with_action: bool) -> Column:
    """The places as text: kind:start:end, or the action and place of the terms alone."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    rows = F.filter("places", lambda s: s["action"].isNotNull()) if with_action else F.col("places")
    name = (lambda s: s["action"]) if with_action else (lambda s: F.element_at(kinds, s["kind"] + 1))
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, actions.

    ``spans`` holds the base spans and spans of kind ``term``, by start, then
    kind. ``actions`` holds remove:start:end for a term to be cut, and
    kind:start:end for one that becomes the word for what it tells about. A
    null text is empty. What is found depends on a row's text and the corpus
    alone: null and repeated ids keep their rows and their own spans, equal
    texts have equal spans. An empty table gives an empty table. Other columns
    of ``docs`` are not read.
    """
    return found_in(docs, id_col, text_col, **options).select(
        "doc_id", *[f"n_{k}" for k in KINDS[:4]], "base_sha256", _listed(False).alias("spans"), _listed(True).alias("actions"))


def sanitised(text: str | None, spans: str, actions: str = "") -> str:
    """The text with every value replaced by its kind in brackets, terms generalised to ``[kind term]`` or cut.

    Overlapping values become one, named after the first. A cut term takes one
    of the blanks around it along.
    """
    text, out, at = text or "", [], 0
    acts = {(int(s), int(e)): k for k, s, e in (x.split(":") for x in actions.split(",") if x)}
    for kind, start, end in ((k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if start >= at:
            act = acts.get((start, end), "") if kind == "term" else ""
            out.append(text[at:start])
            if act != "remove":
                out.append(f"[{act} term]" if act else f"[{kind}]")
            elif out[-1].endswith(" ") and text[end:end + 1] in ("", " "):
                out[-1] = out[-1][:-1]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, text) of each row of ``docs``, sanitised; rows are matched by their text, so ids may repeat or be null.

    A null text becomes empty.
    """
    @F.pandas_udf("string")
    def replaced(texts: pd.Series, spans: pd.Series, actions: pd.Series) -> pd.Series:
        return pd.Series([sanitised(t, s, a) for t, s, a in zip(texts, spans, actions, strict=True)])

    found = found_in(docs, id_col, text_col, **options).select("print", _listed(False).alias("spans"), _listed(True).alias("actions"))
    rows = docs.select(F.col(id_col), text_of(text_col).alias(text_col)).withColumn("print", F.md5(text_col))
    return rows.join(found.dropDuplicates(["print"]), "print").select(
        id_col, replaced(F.col(text_col), F.col("spans"), F.col("actions")).alias(text_col))


def op6(docs: DataFrame) -> DataFrame:
    return find(docs)
