"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """(doc_id, fingerprint) -> doc_id -> least doc_id reachable over two or fewer differing bits."""
    distinct = sorted({p for _, p in prints})
    values = np.array(distinct, dtype=np.uint64)
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        near = np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= 2) + i + 1
        for j in near.tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    group = {p: root(i) for i, p in enumerate(distinct)}
    least = {}
    for doc, p in prints:
        if doc is not None:
            least[group[p]] = min(least.get(group[p], doc), doc)
    return {p: least.get(group[p]) for p in distinct}


def line_dedup(docs, least_chars=20, least_docs=3):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return re.sub("[A-Z]", lambda m: m[0].lower(), k) if len(k) >= least_chars else None

    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if doc is not None and key(line) is not None:
                holders[key(line)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(holders.get(key(x), ())) < least_docs or max(holders[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_pii(text):
    text = text or ""

    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (1 + i % 2)
            total += x - 9 if x > 9 else x
        return total % 10 == 0

    found = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    order = ["email", "ip", "card", "phone"]
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def base_licenses(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i:i + len(own)] == own:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def repeats(docs, length=400):
    counts = Counter()
    raws = [(d, (t or "").encode()) for d, t in docs]
    for _, raw in raws:
        counts.update(hash(raw[i:i + length]) for i in range(len(raw) - length + 1))
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw) + 1, dtype=np.int64)
        for i in range(len(raw) - length + 1):
            if counts[hash(raw[i:i + length])] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        removed = np.cumsum(gone)[:len(raw)] > 0
        runs = int(removed[:1].sum() + (removed[1:] & ~removed[:-1]).sum())
        kept = np.frombuffer(raw, dtype=np.uint8)[~removed].tobytes()
        out.append((d, len(raw), int(removed.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shared_words(docs, words=51):
    rows, found = defaultdict(set), []
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    for row, own in enumerate(split):
        for i in range(len(own) - words + 1):
            rows[tuple(own[i:i + words])].add(row)
    for (d, _), own in zip(docs, split, strict=True):
        inside = set()
        for i in range(len(own) - words + 1):
            if len(rows[tuple(own[i:i + words])]) > 1:
                inside.update(range(i, i + words))
        found.append((d, len(inside)))
    return found


def token_pieces(docs, capacity=2048):
    """doc_id -> ids with the end id, by the library the contract names."""
    import public_tokenizers
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [(d, np.array([*bpe.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")) for d, t in docs]


def crc(ids):
    return zlib.crc32(ids.tobytes())


def edit_within(pattern, text):
    """Least edit distance of ``pattern`` to any part of ``text``, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)
