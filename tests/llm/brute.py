"""Plain restatements of the operators' results, one text or pair at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 75 * (len(a) + len(b) - both)


def components(rows):
    """[(doc_id, text)] -> smallest id reachable, per row."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def quality_counts(text):
    t = text or ""
    w = WORD.findall(t)
    n = len(w)
    windows = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    covered = {i + j for i in range(n - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, repeated = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), repeated, len(covered), failed


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(digits[::-1])) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def repeats(rows, keep_first, window=400):
    """[(doc_id, text)] in order -> (n_bytes, removed bytes' mask) per row."""
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    seen, out = set(), []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            s = t[i : i + window]
            if s in seen if keep_first else count[s] > 1:
                mask[i : i + window] = True
            seen.add(s)
        out.append((t, mask))
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(data):
    return hashlib.sha256(data).hexdigest()


def variants(rows):
    """[(doc_id, text)] -> sorted (word, form, root, n, n_near, form_n), all pairs of words compared."""
    count = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    others = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, found in others.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranked(docs, items, top=50):
    """[(doc_id, text)], [(item_id, text)] -> sorted (item_id, rank, doc_id, score), the formula term by term."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    texts, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in wanted.items():
        found = []
        for d, c, n in counts:
            m = 100 - 50 + ((50 * n * texts) // length)
            score = sum(math.floor(1000 * math.log((2 * texts + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, d is not None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, k + 1, d, -s) for k, (s, _, d) in enumerate(found[:top])]
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
