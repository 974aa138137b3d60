"""Plain restatements of what the operators must return, one row at a time."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"


def words(text):
    return WORD.findall(text or "")


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring(docs, k=13):
    """(doc_id, n_words, n_removed, sha) of rows (doc_id, text)."""
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), sha(kept)))
    return out


def line_dedup(docs, least=10):
    first, ids = {}, defaultdict(set)
    key = lambda line: lower_az(line.strip(BLANK))
    for d, t in docs:
        for line in (t or "").split("\n"):
            k = key(line)
            first[k] = min(first.get(k, d), d)
            ids[k].add(d)
    out = []
    for d, t in docs:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(key(x)) >= least and len(ids[key(x)]) > 1 and first[key(x)] < d)]
        out.append((d, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


def quality(text):
    w = words(text)
    n = len(w)
    grams = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    hit = set()
    for i in range(n - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def shingles(text, k=5):
    w = words(lower_az(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(docs):
    """(doc_id, n_shingles, component_id) by comparing everything that shares a shingle."""
    sets = [(d, shingles(t)) for d, t in docs]
    at = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            at[g].append(i)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    shared = Counter()
    for rows in at.values():
        for a in range(len(rows)):
            for b in range(a):
                shared[rows[b], rows[a]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a][1]) + len(sets[b][1]) - n):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets)]
