"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(seed=1, n=60):
    """Random documents with exact and near copies, a shared passage, odd and missing values, and one long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6))) for _ in range(400)]

    def prose(k):
        return " ".join(rng.choice(vocabulary) for _ in range(k)) + "."

    passage = prose(40)
    texts = [prose(rng.randint(1, 120)) for _ in range(n)]
    for i in range(0, n, 7):
        texts[i] = texts[i] + " " + passage + "\n" + prose(9)
    base = prose(90)
    texts += [base, base, base.upper(), base + " tail", prose(1) + " " + base, passage]
    near = base.split()
    for k in range(12):
        copy = list(near)
        copy[k * 5] = "changed%d" % k
        texts.append(" ".join(copy))
    texts += [None, None, "", "   ", "!!! ???", "123 456", "x", "x", "ab" * 40, "ab" * 60, "漢字だけの文", prose(9000) + passage]
    return [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None, "d")[i % 4], len(t) if t is not None else None)
            for i, t in enumerate(texts)]


def removed(rows, length=50):
    """{id: (bytes, removed, spans, sha256 of the rest)} for distinct ids."""
    first, out = {}, {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first.setdefault(raw[p:p + length], i) < i:
                covered[p:p + length] = b"\1" * length
        kept = bytes(x for x, c in zip(raw, covered) if not c)
        spans = sum(1 for p, c in enumerate(covered) if c and not (p and covered[p - 1]))
        out[i] = (len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def contamination(rows, items, window=13):
    """{id: (words, hit, items with occurring windows)}"""
    found = {}
    for item, text in items:
        w = words(text)
        for p in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[p:p + window]), set()).add(None if item is None else str(item))
    out = {}
    for i, text in rows:
        w, hit, names = words(text), set(), set()
        for size in {len(k) for k in found}:
            for p in range(len(w) - size + 1):
                if tuple(w[p:p + size]) in found:
                    hit |= set(range(p, p + size))
                    names |= found[tuple(w[p:p + size])]
        out[i] = (len(w), len(hit), sorted(names, key=lambda x: (x is None, x)))
    return out


def shingles(text, size=5):
    w = words(text)
    return frozenset(tuple(w[p:p + size]) for p in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def classes(rows, least=0.8):
    """{id: smallest id of its class}"""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in sets}
