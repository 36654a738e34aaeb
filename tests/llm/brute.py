"""Plain versions of the operators, to compare with."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

_LOW = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))


def contamination(docs, items):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = rx.findall((text or "").translate(_LOW))
        for i in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[i : i + 10])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = rx.findall((text or "").translate(_LOW)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def shingles(text, width=4):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_duplicates(docs, width=4, percent=85):
    sets = [shingles(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        groups[root(i)].append(doc)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(docs)]


def repeated(docs, least=50):
    seen = defaultdict(set)
    split = [words(t) for _, t in docs]
    for i, w in enumerate(split):
        for k in range(len(w) - least + 1):
            seen[tuple(w[k : k + least])].add(i)
    out = defaultdict(set)
    for i, w in enumerate(split):
        for k in range(len(w) - least + 1):
            if len(seen[tuple(w[k : k + least])]) > 1:
                out[docs[i][0]].update(range(k, k + least))
    return dict(out)


def statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            covered.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
