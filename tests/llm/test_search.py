"""Ranked search, spelling variants and near vectors against plain versions, with awkward rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import ranking, variants, vectors
from ridgeline.llm.small_world import SmallWorld

LOW = {i: i + 32 for i in range(65, 91)}
RNG = random.Random(5)
WORDS = ["".join(RNG.choices("abcdeñé", k=RNG.randint(1, 5))) for _ in range(60)] + ["中文", "x1", "😀"]


def prose(n):
    return " ".join(RNG.choices(WORDS, k=n))


DOCS = [(i, prose(RNG.randint(1, 60))) for i in range(60)] + [(70, None), (71, ""), (72, " .,- "), (73, prose(30_000)), (None, prose(9)), (74, "same text here x1"), (75, "Same TEXT here x1"), (75, "Same TEXT here x1")]
ITEMS = [(1, prose(6)), (2, prose(12)), (2, "x1 x1"), (3, None), (4, ""), (5, "nowhere to be found"), (6, "same here"), (None, prose(3))]


def plain_ranking(docs, items, k):
    rx = re.compile(ranking.TERM)
    cut = [(d, Counter(rx.findall((t or "").translate(LOW)))) for d, t in docs]
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(rx.findall((t or "").translate(LOW)))
    n_docs, total = sum(1 for _, c in cut if c), sum(sum(c.values()) for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item, terms in asked.items():
        scores = []
        for d, c in cut:
            m = 10 + 90 * sum(c.values()) * n_docs // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k, block, at_once", [(10, 1 << 20, 1 << 20), (3, 200, 50)])
def test_ranking(spark, monkeypatch, k, block, at_once):
    """Also in blocks of few items and with few pairs sorted at once."""
    monkeypatch.setattr(ranking, "AT_ONCE", at_once)
    docs = spark.createDataFrame([(*r, 1, "x") for r in DOCS], "doc_id bigint, text string, n int, term string").repartition(3)
    items = spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id bigint, text string, score int")
    got = ranking.ranked(docs, items, k, block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_ranking(DOCS, ITEMS, k)
    assert ranking.ranked(docs.limit(0), items, k, block).count() == 0
    assert ranking.ranked(docs, items.limit(0), k, block).count() == 0


def test_equal_hashes_are_told_apart(monkeypatch):
    """Terms with one hash are compared byte by byte."""
    from pyspark.sql import Row

    monkeypatch.setattr(ranking, "span_hashes", lambda data, begins, ends: np.full(len(begins), 7, np.uint64))
    asked = ranking._Asked([Row(item_id=1, term="abc"), Row(item_id=1, term="abd"), Row(item_id=2, term="ab")])
    data = np.frombuffer(b"abdabcabx", np.uint8)
    found = asked.match(data, np.array([0, 3, 6, 6]), np.array([3, 6, 9, 8]))
    names = [bytes(asked.bytes[b : b + n]).decode() for b, n in zip(asked.begins, asked.lengths)]
    assert [names[x] if x >= 0 else None for x in found] == ["abd", "abc", None, "ab"]


def test_radix_order():
    keys = np.random.default_rng(1).integers(0, 1 << 40, 5000)
    keys[::3] = keys[0]
    assert (ranking.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(ranking.radix_order(np.zeros(0, np.int64))) == 0


def plain_variants(docs, least_length, least_count):
    total = Counter()
    for d, t in docs:
        for w, n in Counter(re.findall("[A-Za-zÀ-ÿ]+", t or "")).items():
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            total[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += n
    words = {w: n for w, n in total.items() if len(w) >= least_length and n >= least_count}
    alphabet = {c for w in words for c in w}
    near = {}
    for w in words:
        one = {w[:p] + w[p + 1 :] for p in range(len(w))} | {w[:p] + c + w[p + q :] for p in range(len(w) + 1) for c in alphabet for q in (0, 1)}
        near[w] = (one - {w}) & words.keys()
    best = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: b if b and words[b] >= 2 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, n, len(near[w]), form[w], form[w] and words[form[w]], root(w)) for w, n in words.items()), key=repr)


def variant_docs():
    """Words of few letters, so that many are near; half of them begin alike, and frequencies fall steeply."""
    rng = random.Random(2)
    base = ["".join(rng.choices("abéß", k=rng.randint(5, 9))) for _ in range(250)] + ["aaaab" + "".join(rng.choices("abcd", k=rng.randint(0, 4))) for _ in range(250)] + ["aaaaa", "aaaaaa", "aaaaaaa", "Àààààà", "àààààà", "x×÷yzz"]
    texts = [" ".join(rng.choices(base, [1 / (i % 40 + 1) for i in range(len(base))], k=200)) for _ in range(30)] + [" ".join(["Length", "lengthy", "lengt"] * k) for k in (3, 20)]
    return list(enumerate(texts)) + [(None, texts[0]), (5, texts[5].upper()), (90, None), (91, ""), (92, "1 2 3"), (93, "long" * 40_000), (94, "abcde" * 2000 + " " + "abcde" * 2000), (95, "abcde" * 2000)]


@pytest.mark.parametrize("shard, scanned", [(5_000, 100_000), (7, 11)])
def test_variants(spark, shard, scanned):
    """Also in shards of few words, where one half that most words share fills many."""
    rows = variant_docs()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n int, word string").repartition(3)
    got = variants.spelling_variants(docs, shard=shard, scanned=scanned).select("word", "n", "n_near", "form", "form_n", "root")
    want = plain_variants(rows, 5, 3)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert any(r[3] and r[5] != r[3] for r in want) and max(r[2] for r in want) > 5
    assert variants.spelling_variants(docs.limit(0)).count() == 0
    assert variants.spelling_variants(docs.filter("doc_id in (90, 91, 92)")).count() == 0


def vector_rows():
    rng = np.random.default_rng(4)
    out, crowd = [], rng.normal(size=16)
    for i in range(420):
        out.append((int(rng.integers(0, 3)), rng.normal(size=16)))
    out += [(1, crowd + 0.02 * rng.normal(size=16)) for _ in range(180)]  # a crowd, all near one another
    chain = rng.normal(size=16)
    for _ in range(40):  # each near the next, the ends are not near
        chain = chain + 0.25 * rng.normal(size=16)
        out.append((2, chain))
    out += [(0, out[0][1] * 3.5 if out[0][0] == 0 else out[0][1]) for _ in range(30)]
    rows = [(1000 - i, label, [float(x) for x in v]) for i, (label, v) in enumerate(out)]
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(50)]
    rows += [(3000, None, rows[5][2]), (3001, 1, None), (3002, 1, []), (3003, 1, [0.0] * 16), (3004, 1, [float("nan")] * 16), (3005, 1, [float("inf")] + [1.0] * 15), (3006, 1, [None] + [1.0] * 15), (3007, 1, [1.0] * 3), (3008, 1, [2.0] * 3)]
    return rows + [(3009, 1, [-0.0, 1.0]), (3010, 1, [0.0, 1.0]), (3011, 1, [1e200, 1e200]), (3012, 1, [1.0, 1.0]), (None, rows[5][1], rows[5][2])]


def plain_vectors(rows):
    good = [i for i, (k, label, v) in enumerate(rows) if k is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for label, dim in {(rows[i][1], len(rows[i][2])) for i in good}:
        own = [i for i in good if rows[i][1] == label and len(rows[i][2]) == dim]
        m = np.array([rows[i][2] for i in own])
        m /= np.abs(m).max(1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(m @ m.T >= 0.93)):
            if a != b:
                links[own[a]].add(own[b])
    comp, out = {}, []
    for i in sorted(good, key=lambda i: rows[i][0]):
        if i not in comp:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in comp:
                    comp[j] = rows[i][0]
                    todo += links[j]
    for i, (k, _, _) in enumerate(rows):
        c = comp.get(i, k)
        out.append((k, len(links[i]), c, k == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_rows", [32_768, 100])
def test_vectors(spark, shard_rows):
    """Also over many small shards. The crowd is wider than the first beam."""
    rows = vector_rows()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, label int, embedding array<double>, n int, key string").repartition(3)
    got = vectors.near_vectors(frame, shard_rows)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_vectors(rows)
    assert vectors.near_vectors(frame.limit(0)).count() == 0
    assert vectors.near_vectors(frame.filter(F.col("vec_id") > 2999).filter("label is null")).collect()[0].kept


def test_small_world_recall():
    """Graphs alone, without a look at the whole shard: crowds and scattered vectors."""
    rng = np.random.default_rng(9)
    vec = np.concatenate([rng.normal(size=(3000, 32)), rng.normal(size=(40, 1, 32)).repeat(30, 1).reshape(-1, 32) + 0.1 * rng.normal(size=(1200, 32))])
    vec = vectors.units(list(rng.permutation(vec)))
    graph = SmallWorld.built(vec)
    row, node, crowded = vectors.searched(graph, vec)
    true = vec @ vec.T >= vectors.LINK
    assert not len(crowded) and true[row, node].all()
    assert len(row) / true.sum() >= 0.99
    # a beam that is too narrow is found out by the audit, and crowds are left to the whole shard
    narrow, beams = SmallWorld(vec, graph.layers), []
    narrow.beam = lambda k, queries, entries, width, step=4: beams.append(width) or SmallWorld.beam(graph, k, queries, entries, width, step)
    row, node, crowded = vectors.searched(narrow, vec, 2)
    quiet = ~np.isin(np.arange(len(vec)), crowded)
    assert len(row) / true[quiet].sum() >= 0.98 and max(beams) > 4
