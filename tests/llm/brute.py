"""Plain-Python answers that the operators are held against."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def word_list(text):
    return WORD.findall(lower(text).encode())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text):
    w = word_list(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def least_reachable(ids, linked):
    """The smallest id reachable from each row; linked holds pairs of row numbers."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in linked:
        root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min([x for x in (low.get(find(i)), d) if x is not None], default=None)
    return [low[find(i)] for i in range(len(ids))]


def jaccard(rows):
    """(n_shingles, component) of each (doc_id, text)."""
    sets = [shingle_set(t) for _, t in rows]
    pairs = [(i, j) for i, a in enumerate(sets) for j in range(i) if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j])]
    return [(len(s), c) for s, c in zip(sets, least_reachable([d for d, _ in rows], pairs))]


def repeats(rows, length=200):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each (doc_id, text)."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k:k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def contained(docs, items):
    """(doc_id, item_id, size, shared) wherever 75 % of an item's set are in a document's."""
    def grams(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    union = defaultdict(set)
    for d, t in docs:
        union[d] |= grams(t)
    return {(d, i, len(g), len(g & s)) for i, t in items if (g := grams(t)) for d, s in union.items() if 100 * len(g & s) >= 75 * len(g)}


ASSIGN = r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def _joined(found):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def secrets(text):
    """(counts, base spans joined) of a text."""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(ASSIGN, text or "") if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return [sum(x[3] == k for x in found) for k in ("assign", "access", "hex")], _joined(found)


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    """(counts, base spans joined) of a text."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def passes(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        if kind == "ip":
            return all(int(x) <= 255 for x in hit.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and _luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    found = [(m.start(), r, m.end(), k) for r, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, text or "") if passes(k, m[0])]
    return [sum(x[3] == k for x in found) for k in patterns], _joined(found)
