"""The ten operators on one small table of awkward rows: nulls, empty and long texts, copies, repeated rows, clashing names."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import byte_bpe, decontaminate, language, neardup, pii, pretokens, quality, repeats, token_files, toxicity, urls

from . import brute

RNG = random.Random(11)
VOCAB = ["".join(RNG.choices("abcdefghijklmnoprstuvwyzéñß", k=RNG.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choices(VOCAB, k=n)).capitalize() + "."


BASE, PASSAGE, ITEM = prose(300), prose(60), prose(14)
TEXTS = [
    BASE, BASE, BASE.replace(BASE.split()[50], "other"), BASE + " tail", prose(120) + "\n" + PASSAGE + "\n" + prose(80), prose(90) + " " + PASSAGE + " " + prose(30), prose(40) + " " + ITEM.upper() + " " + prose(9),
    None, "", " \n\t ", "one two", "one two", "THREE words here", prose(4000), "same line\n" * 30, "%%% ### $$$ " * 20 + prose(10), "Mail ann.lee@mail.example.org or +1 (212) 555-0187, card 4111 1111 1111 1111, 10.1.2.3",
    "Mrs Anna Smith met Mr Smith; write ann.lee@mail.example.org", "Ünïcödé ñandú 中文字符 😀 it's we'll don't \r\n end", ITEM,
]
ROWS = [(i, t, ("en", "de", None)[i % 3], "src0" if i % 2 else None, 0, 5.5) for i, t in enumerate(TEXTS)] + [(None, "no id at all", "en", "src1", 0, 1.0), (3, TEXTS[3], "en", "src0", 0, 5.5)]
#: The names k, c, term, n_words, start and key clash with names inside the operators.
SCHEMA = "doc_id bigint, text string, lang string, source string, k int, c double"
DOCS = [(r[0], r[1]) for r in ROWS]
ITEMS = [(1, ITEM), (2, ITEM), (3, "one two"), (4, None), (5, ""), (10, PASSAGE)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns({"term": F.lit(1), "n_words": F.lit("x"), "start": F.lit(2), "key": F.lit("y")}).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def test_decontamination(docs, empty, items):
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows(decontaminate.contamination(docs, items, "doc_id"), *names) == sorted(brute.contamination(DOCS, ITEMS), key=repr)
    assert decontaminate.contamination(empty, items, "doc_id").count() == 0
    assert not decontaminate.contamination(docs, items.limit(0), "doc_id").filter("contaminated").count()
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(repr, [r.doc_id for r in kept.collect()])) == sorted(repr(x[0]) for x in brute.contamination(DOCS, ITEMS) if not x[5])


def test_proximity(spark):
    """Against a plain check: all words of a window, as often as in it, less than the width away from its rarest one."""
    from collections import Counter

    rng = random.Random(3)
    items_ = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(3, 12)))) for i in range(6)] + [(9, "rare a a")]
    texts = [" ".join(rng.choices("abcdefghxyz", k=60)) for _ in range(40)] + ["a x rare y a", "a rare x", "rare " + "z " * 60 + "a a", "a a rare"]
    docs_ = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    got = {r.doc_id: r.n_near for r in decontaminate.contamination(docs_, spark.createDataFrame(items_, "item_id bigint, text string"), "doc_id").collect()}
    counts = Counter(w for t in texts for w in t.split())
    windows = {tuple(w[i : i + 10]) for _, t in items_ for w in [t.split()] for i in range(max(1, len(w) - 9))}
    for i, t in enumerate(texts):
        words, n = t.split(), 0
        for window in windows:
            rarest = min(((counts[w], k, w) for k, w in enumerate(window)))[2]
            near = [Counter(words[max(0, p - 9) : p + 10]) for p, w in enumerate(words) if w == rarest]
            n += any(all(c[w] >= k for w, k in Counter(window).items()) for c in near)
        assert got[i] == n
    assert [got[i] for i in range(40, 44)] == [1, 0, 0, 1]


def test_decontamination_beyond_a_broadcast(docs, items, monkeypatch):
    from ridgeline.llm import scratch

    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 0)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows(decontaminate.contamination(docs, items, "doc_id"), *names) == sorted(brute.contamination(DOCS, ITEMS), key=repr)


def test_near_duplicates(docs, empty):
    assert rows(neardup.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == sorted(brute.near_duplicates(DOCS), key=repr)
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    groups = brute.near_duplicates(DOCS, 5, 80)
    want = {x[0] for x in groups if x[1] == 0 or x[0] == x[2]}
    assert sorted(map(repr, [r.doc_id for r in kept.collect()])) == sorted(map(repr, want))


def test_large_group_of_near_copies(spark):
    """A group beyond a leaf of the trees, chains in it, and documents that share a passage with all of it but are no copies."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = f"v{rng.random()}"
        texts.append(" ".join(own))
    texts += [" ".join(base[:60] + [f"u{i}_{k}" for k in range(60)]) for i in range(80)]
    data = list(enumerate(texts))
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string").repartition(3))
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.near_duplicates(data), key=repr)


def test_language(docs, empty):
    out = {r.doc_id: r for r in language.identified(docs).collect()}
    assert len(out) == len({r[0] for r in ROWS})
    assert (out[7].lang_pred, out[7].score, out[8].lang_pred) == ("und", 0.0, "und")
    assert {r.lang_pred for r in out.values()} <= {"en", "de", "und"}
    assert all(0 <= r.score <= 1 for r in out.values())
    assert language.identified(empty).count() == 0
    assert {r.lang_pred for r in language.predicted(docs, language.train(empty)).collect()} == {"und"}


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="2 languages"):
        language.train(spark.createDataFrame([("a b", "en"), ("c d", "de")], "text string, lang string"))


def test_mixed_spans(spark):
    greek, latin = "καλημερα κοσμε αυτο ειναι ενα κειμενο", "good morning world this is a text"
    train = spark.createDataFrame([(greek, "el"), (latin, "en")] * 3, "text string, lang string")
    found = language.predicted(spark.createDataFrame([(1, latin + " " + greek + " " + greek)], "doc_id bigint, text string"), language.train(train), spans=True).first()
    assert found.lang_pred == "el"
    assert [(s["lang"], s["begin"], s["end"]) for s in found.spans] == [("en", 0, 7), ("el", 7, 19)]


def test_best_path_is_best():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(9, 3)) * 4
    got = language.best_paths(scores.astype(np.float32), np.array([0, 4, 4, 9]), 2.0)
    value = lambda path, s: s[np.arange(len(path)), path].sum() - 2.0 * (np.diff(path) != 0).sum()
    for b, e in ((0, 4), (4, 9)):
        every = np.array(np.meshgrid(*[range(3)] * (e - b))).reshape(e - b, -1).T
        assert value(got[b:e], scores[b:e]) == pytest.approx(max(value(p, scores[b:e]) for p in every), abs=1e-4)


def test_words_encoded_together(monkeypatch):
    """Words go to the library as few texts, are kept, forgotten and cut as by themselves, whatever they hold."""
    path, sent = token_files.vocabulary(), []
    tok = token_files._tokenizer(path)

    class Counted:
        def __getattr__(self, name):
            return getattr(tok, name)

        def encode_batch_fast(self, texts, **kw):
            sent.extend(texts)
            return tok.encode_batch_fast(texts, **kw)

    monkeypatch.setattr(token_files, "_tokenizer", lambda _: Counted())
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeéßñжя中", k=rng.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(60)] + ["", "it's 12 </w> x", "a\u0085b \u0301e \x00 \u200b", "Σίσυφος İı ﬁ"]
    want = [[*tok.encode(t, add_special_tokens=False).ids, token_files.END] for t in texts]
    for kept in (400_000, 700, 1):
        monkeypatch.setattr(token_files, "KEPT_WORDS", kept)
        token_files._KNOWN.clear()
        for i in range(0, len(texts), 8):
            ids, sizes = token_files.text_ids(texts[i : i + 8], path)
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want[i : i + 8]
        if kept == 400_000:
            assert len(sent) < len(words) // 10
    token_files._KNOWN.clear()
    odd = ["two words", "\u00a0", "x", "don't", "一", ""]
    ids, sizes = token_files.encoded_words(odd, path)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [tok.encode(w, add_special_tokens=False).ids for w in odd]


def test_near_duplicates_hand_over_few_rows_at_once(spark, monkeypatch):
    """Workers get small batches of texts; afterwards the session is as before."""
    name, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], neardup.written
    before = spark.conf.get(name)
    monkeypatch.setattr(neardup, "written", lambda df, x: seen.append(int(spark.conf.get(name))) or write(df, x))
    text = " ".join(f"w{i}" for i in range(60))
    data = [(i, text + " end" * (i % 2)) for i in range(6)] + [(9, "other words of another text")]
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: 0 if i < 6 else 9 for i, _ in data}
    assert max(seen) <= 1000
    assert spark.conf.get(name) == before


def test_near_duplicates_write_few_files(spark, monkeypatch):
    """Tables of few rows have few files over many shuffle partitions: each file costs an executor processes of its own."""
    from pathlib import Path

    from ridgeline.llm import components, scratch

    files, cores = {}, spark.sparkContext.defaultParallelism

    def write(df, name):
        table = scratch.written(df, name)
        files.setdefault(name, []).append(len(list(Path(table.scratch_path.removeprefix("file://")).glob("part-*"))))
        return table

    monkeypatch.setattr(neardup, "written", write)
    monkeypatch.setattr(components, "written", write)
    text = [[f"w{g}x{i}" for i in range(60)] for g in range(150)]
    data = [(2 * g + k, " ".join(t[:30] + [f"new{g}"] * k + t[30:])) for g, t in enumerate(text) for k in (0, 1)]
    data += [(1000 + g, " ".join(["many"] + [f"y{i}" for i in range(80)] + [f"z{g}"])) for g in range(80)]
    options = {"spark.sql.shuffle.partitions": str(cores + 30), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string").coalesce(2))
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(brute.near_duplicates(data))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {"classes", "trees", "texts", "class-links", "crowded-trees", "labels"} <= files.keys()
    assert {k: v for k, v in files.items() if max(v) > 2 * cores and k not in ("leaf-pairs", "pairs")} == {}


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.vocabulary())
    got = sorted(token_files.round_trip(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x or 0))
    text, at = dict(DOCS), 0
    for r in got:
        ids = [*tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), brute.crc(ids))
        at += len(ids)
    assert token_files.round_trip(empty).count() == 0


def test_added_tokens(spark):
    """Markers of the vocabulary in raw text have the library's ids, and so have the texts beside them."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.vocabulary())
    texts = ["plain", "hello <|endoftext|> world", "<|startoftext|>", "a<|endoftext|>B <|startoftext|>c", "<|EndOfText|> É", "<|endoftext|>\u0338 x", "", "after <| endoftext |>"]
    want = [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert 49407 in want[1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.round_trip(docs).collect()}
    assert got == {i: (len(x), brute.crc(x)) for i, x in enumerate(want)}


@pytest.mark.parametrize("ids", [[5], [0, 2**32 - 1], [7] * 9000, list(range(9000)), [1] * 5000 + [10**9] + [2] * 5000])
def test_blocks(ids):
    import io

    out = io.BytesIO()
    writer = token_files.FileWriter(out)
    writer.add(np.array(ids, np.uint32), [None], [len(ids)])
    writer.end()
    reader = token_files.FileReader(out, len(out.getvalue()))
    [(docs, lengths, back)] = list(reader.documents())
    assert (docs, lengths.tolist()) == ([None], [len(ids)])
    assert back.tolist() == ids
    for begin, end in ((0, 0), (len(ids) // 3, len(ids) // 2 + 1), (len(ids) - 1, len(ids))):
        assert reader.ids_between(begin, end).tolist() == ids[begin:end]


def test_files_roll_by_size(spark, tmp_path):
    """Several files a partition, a few blocks read at a time, a document over many blocks, one id for a third of the rows."""
    texts = [prose(RNG.randint(1, 60)) for _ in range(60)] + [prose(3000)]
    data = [(i if i % 3 else 7, t) for i, t in enumerate(texts)]
    docs_ = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    folder = f"file://{tmp_path}/f"
    files = token_files.write_files(docs_, token_files.vocabulary(), folder, 300)
    assert files.count() > 8
    assert files.agg(F.sum("docs")).first()[0] == 61
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.vocabulary())
    got = sorted(token_files.read_files(folder, files, 1).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in data)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    want = sorted((i, bytes(np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t in data)
    assert sorted((r.doc_id, bytes(r.ids)) for r in got) == want


def test_urls(spark):
    cases = [
        ("http://A.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"), ("https://www.example.com/en/x?y", "www.example.com", "/en/x", "www.example.com/en/", "allow"), ("http://x.net/es/", "x.net", "/es/", "net/es/", "block"),
        ("http://x.com", "x.com", "", None, None), ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), (None, "", "", None, None), ("no scheme", "", "", None, None), ("http://h#f", "h", "", None, None), ("", "", "", None, None),
    ]
    pages = spark.createDataFrame([(i, c[0], 1) for i, c in enumerate(cases)] + [(0, cases[0][0], 1)], "page_id bigint, url string, length int")
    for r in urls.judged(pages, "page_id").collect():
        _, host, path, rule, verdict = cases[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert urls.judged(pages.limit(0), "page_id").count() == 0
    assert {r.verdict for r in urls.judged(pages.filter("page_id > 4"), "page_id").collect()} == {"allow"}
    assert [r.verdict for r in urls.judged(pages.filter("page_id in (2, 5)"), "page_id").collect()] == ["block", "block"]


def test_url_statistics_cover_all_rows(spark, monkeypatch):
    """Shares of blocked URLs are counted over all rows; a URL that holds a third of them counts once among those learned from."""
    counted, learned, plain = [], [], urls.suffix_statistics

    class Recorded(urls.GBTClassifier):
        def fit(self, dataset, params=None):
            learned.extend(dataset.select("label", "weight").collect())
            return super().fit(dataset, params)

    monkeypatch.setattr(urls, "TRAIN_ROWS", 60)
    monkeypatch.setattr(urls, "GBTClassifier", Recorded)
    monkeypatch.setattr(urls, "suffix_statistics", lambda labelled, *a: counted.append(labelled.count()) or plain(labelled, *a))
    names = [f"http://h{i}.site{i % 40}.{('com', 'net')[i % 2]}/es/{i}" for i in range(400)] + ["http://hot.com/x"] * 200 + [f"http://other{i}.org/" for i in range(5)]
    assert urls.judged(spark.createDataFrame(list(enumerate(names)), "page_id bigint, url string"), "page_id").count() == len(names)
    assert counted == [600, 600]
    assert 40 < len(learned) < 240
    hot = [r for r in learned if r.weight > 100]  # once with its suffixes and once without
    assert [r.label for r in hot] == [0.0, 0.0]
    weights = [sum(r.weight for r in learned if r.label == y) for y in (0.0, 1.0)]
    assert weights[0] == pytest.approx(weights[1])


def test_urls_learned(spark):
    """What is learned from one rule of a suffix holds for another one; hosts under unknown suffixes are allowed in doubt; a long URL is whole."""
    rules = (("allow", "com", "/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
    rng = random.Random(8)
    made = lambda end: f"https://h{rng.randrange(60)}.site{rng.randrange(12)}.{end}/{rng.choice(('es', 'fr'))}/{rng.randrange(10_000)}"
    urls_ = [made(rng.choice(("com", "net"))) for _ in range(600)] + [made("org") for _ in range(20)] + ["https://x.net/en/" + "a/" * 20_000]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id bigint, url string").repartition(3)
    got = urls.judged(pages, "page_id", rules=rules, unknown=("net/fr/",)).collect()
    assert {r.verdict for r in got if r.rule == "net/fr/"} == {"block"}
    assert {r.verdict for r in got if r.host.endswith(".org")} == {"allow"}
    assert [len(r.path) for r in got if r.host == "x.net"] == [len(urls_[-1]) - len("https://x.net")]


def test_toxicity(spark, docs, empty):
    bad = ["you are a gromblat fool " + prose(30) for _ in range(40)]
    data = [(100 + i, t, 1) for i, t in enumerate(bad)] + [(200 + i, prose(40), 0) for i in range(60)]
    table = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, "what a gr0mbl@t"), (901, "g r o m b l a t"), (902, "groooomblat"), (903, prose(30)), (904, None), (905, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in data] + [(100, 1, 0), (None, 1, 0), (201, None, 0)], "doc_id bigint, toxic int, quality int")
    out = {r.doc_id: r for r in toxicity.toxicity(table, labels).collect()}
    assert [out[i].predicted for i in (900, 901, 902, 903, 904, 905)] == [1, 1, 1, 0, 0, 0]
    assert all(out[i].predicted == y for i, _, y in data)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_trigrams_of_all_documents(spark):
    """The character model knows the words of documents without a label, whatever the labels."""
    table = spark.createDataFrame([(i, f"labelled {i}") for i in range(4)] + [(9, "Жуткий wörd жуткий"), (10, None), (11, "ЖУТКИЙ")], "doc_id bigint, text string").repartition(2)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id bigint, toxic int")
    for known in (labels, labels.limit(0)):
        found = toxicity.train(table, known).letters.count
        assert (found("жут"), found("wör"), found("lab")) == (2, 1, 4)


@pytest.fixture(scope="module")
def letters():
    held = {}
    for w in ["this", "is", "a", "long", "line", "of", "plain", "words", "and", "then", "idiot", "good"] * 50:
        for i in range(len(w) + 1):
            gram = ("  " + w + " ")[i : i + 3]
            held[gram] = held.get(gram, 0) + 1
    return toxicity.Letters(held)


@pytest.mark.parametrize("text", ["idioot", "idiiot", "i_d_i_o_t", "i  d  i  o  t", "i..d..i..o..t", "!diot", "id*ot", "i**ot", "i" + "d" * 90 + "iot"])
def test_disguises(letters, text):
    assert "idiot" in toxicity.Restorer(letters).words("and then " + text + " and").split()


@pytest.mark.parametrize(("between", "apart"), [(" ", "  "), (".", "..")])
def test_long_stretch_is_read_whole(letters, between, apart):
    plain = "this is a long line of plain words and then " * 9 + "idiot"
    text = apart.join(between.join(w) for w in plain.split())
    assert len(text) > 600
    assert toxicity.Restorer(letters).words(text).split()[-1] == "idiot"
    assert toxicity.Restorer(letters).words("good words") == ""


def test_pii(docs, empty):
    out = {r.doc_id: r for r in pii.replaced(docs, "secret", counts=True).collect()}
    assert pii.replaced(docs, "secret").columns == docs.columns
    assert out[7].text is None
    for i, t in DOCS:
        if i not in (16, 17):
            assert (out[i].text, out[i].n_entities) == (t, 0)
    mail = out[16].text.split()[1]
    assert mail != "ann.lee@mail.example.org"
    assert out[17].text.endswith(mail)
    assert (out[16].n_entities, out[17].n_entities) == (4, 3)
    assert "4111" not in out[16].text
    assert "10.1.2.3" not in out[16].text
    card = [int(c) for c in out[16].text.split("card ")[1].split(",")[0] if c.isdigit()]
    assert len(card) == 16
    assert sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(card)) % 10 == 0
    title, given, family = out[17].text.split(" met ")[0].split()
    assert title == "Mrs"
    assert given in pii.GIVEN["f"]
    assert family != "Smith"
    assert f"Mr {family};" in out[17].text
    assert pii.replaced(empty, "secret").count() == 0


def test_pii_collisions(spark, monkeypatch):
    """Surrogates that meet, or that are entities themselves, are drawn again."""
    plain = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda kind, value, attempt, key: F.when(attempt == 0, F.lit("a1@x.example.org")).otherwise(plain(kind, value, attempt, key)))
    found = spark.createDataFrame([("email", v) for v in ("a1@x.example.org", "b@x.org", "c@x.org")], "kind string, value string")
    got = [r.surrogate for r in pii.surrogates(found, "k").collect()]
    assert len(set(got)) == 3
    assert not {"a1@x.example.org", "b@x.org", "c@x.org"} & set(got)


def test_pii_spaces_run_out(spark, monkeypatch):
    """More entities than one format has surrogates: the rounds end, and surrogates stay distinct and new."""
    monkeypatch.setattr(pii, "ATTEMPTS", 3)
    plain = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda kind, value, attempt, key: F.when(kind == "social", F.concat(F.lit("000-00-000"), F.pmod(F.xxhash64(value, attempt), F.lit(10)).cast("string"))).otherwise(plain(kind, value, attempt, key)))
    values = [f"123-45-{i:04d}" for i in range(40)]
    got = [r.surrogate for r in pii.surrogates(spark.createDataFrame([("social", v) for v in values], "kind string, value string"), "k").collect()]
    assert len(set(got)) == 40
    assert not set(got) & set(values)


def test_pii_coreference_and_distinctness(spark, monkeypatch):
    """Against a plain check: equal parts stay equal, different entities of any type stay different, also behind collisions."""
    plain = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda kind, value, attempt, key: F.when((attempt == 0) & kind.isin("family", "local"), F.lit("Ada")).otherwise(plain(kind, value, attempt, key)))
    text = (
        "Mr John Doe and Mrs Doe met John Roe. My name is Jane Doe. Name: Zoe Wirth; bob@corp.com wrote amy@corp.com, BOB@Corp.com and bob@other.org. "
        "From 2001:db8::ff00:42:8329 and fe80:0:0:0:1:2:3:4 at 12:30:45 to 10.0.0.7; Mr Иванов met Мария Иванов"
    )
    docs_ = spark.createDataFrame([(1, text), (2, "Dr Doe, bob@corp.com. " * 300), (3, text)], "doc_id bigint, text string").repartition(2)
    out = {r.doc_id: r for r in pii.replaced(docs_, "secret", counts=True).collect()}
    assert out[1].text == out[3].text
    assert out[1].n_entities == 14
    assert "12:30:45" in out[1].text
    words = out[1].text.replace(";", "").replace(",", "").replace(".\x20", " ").split()
    full, mrs, roe = words[:3], words[4:6], words[7:9]
    assert (full[0], mrs[0], full[2], full[1]) == ("Mr", "Mrs", mrs[1], roe[0])
    family = full[2]
    assert f"My name is" in out[1].text and out[1].text.split("My name is ")[1].split(". ")[0].endswith(family)
    assert f"Dr {family}," in out[2].text
    mails = [w.rstrip(".") for w in words if "@" in w]
    assert (mails[0], mails[0].split("@")[1], mails[0].split("@")[0]) == (mails[2], mails[1].split("@")[1], mails[3].split("@")[0])
    assert len(set(mails)) == 3
    for gone in ("Doe", "Roe", "Wirth", "corp.com", "2001:db8", "10.0.0.7", "Иванов"):
        assert gone not in out[1].text
    assert out[2].text.count(mails[0]) == 300


def test_repeats(docs, empty):
    covered = {}
    for r in repeats.repeats(docs).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.begin, r.begin + r.words))
    want = brute.repeated(DOCS)
    assert covered == want
    assert repeats.repeats(empty).count() == 0


def test_repeats_around_a_frequent_passage(spark):
    """Pairs share little more than a passage that all documents hold; edited copies share stretches between the edits."""
    rng = random.Random(5)
    own = lambda n: [f"u{rng.random()}" for _ in range(n)]
    common, base = own(48), own(400)
    ends = [(own(2), own(2)) for _ in range(60)]
    texts = [own(40) + a + common + b + own(40) for a, b in ends * 2] + [own(40) + common + own(40) for _ in range(80)]
    texts += [own(40) + common[:k] + own(40) for k in (40, 45)]
    for _ in range(40):
        copy = list(base)
        for k in rng.sample(range(400), 5):
            copy[k] = own(1)[0]
        texts.append(copy)
    data = [(i, " ".join(t)) for i, t in enumerate(texts)]
    covered = {}
    for r in repeats.repeats(spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.begin, r.begin + r.words))
    assert covered == brute.repeated(data)


@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping_repeats(spark, seed):
    """Groups of 3 to 10 documents share overlapping stretches of a passage; whole copies of one text beside them."""
    rng = random.Random(seed)
    own = lambda n: [f"u{rng.random()}" for _ in range(n)]
    texts = []
    for _ in range(40):
        passage = own(200)
        for _ in range(rng.randint(3, 10)):
            begin = rng.randrange(140)
            texts.append(own(rng.randrange(60)) + passage[begin : begin + rng.randint(40, 120)] + own(rng.randrange(60)))
    data = [(i, " ".join(t)) for i, t in enumerate(texts)]
    data += [(1000 + i, data[0][1]) for i in range(30)]
    covered = {}
    for r in repeats.repeats(spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.begin, r.begin + r.words))
        a, b = (brute.words(dict(data)[i]) for i in (r.doc_id, r.shared_with))
        a = a[r.begin : r.begin + r.words]
        assert {tuple(a[i : i + 50]) for i in range(len(a) - 49)} & {tuple(b[i : i + 50]) for i in range(len(b) - 49)}
    assert covered == brute.repeated(data)


def test_repeats_of_texts_that_meet(spark, monkeypatch):
    """Different texts under one 64-bit number stay different."""
    rng = random.Random(6)
    own = lambda n: [f"u{rng.random()}" for _ in range(n)]
    passage = own(70)
    data = [(i, " ".join(own(30) + (passage if i % 3 == 0 else []) + own(40))) for i in range(20)] + [(50, "few words"), (51, None)]
    data += [(60 + i, data[i][1]) for i in (1, 2)]
    monkeypatch.setattr(repeats, "text_keys", lambda: [F.pmod(F.xxhash64("text"), F.lit(3)).alias("c"), F.xxhash64(F.lit(1), "text").alias("c2")])
    covered = {}
    for r in repeats.repeats(spark.createDataFrame(data, "doc_id bigint, text string").repartition(2)).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.begin, r.begin + r.words))
    assert covered == brute.repeated(data)


def test_few_estimates_need_no_tables(spark, monkeypatch):
    """The steps of few groups write nothing; many groups go by tables to the same verdicts."""
    rng = random.Random(11)
    data = [(i, " ".join("w" * rng.randint(1, 9) + str(rng.randint(0, 999)) for _ in range(rng.randint(12, 200))), "en" if i % 2 else None, "s") for i in range(240)]
    docs_, made, write = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string"), [], quality.written
    monkeypatch.setattr(quality, "written", lambda df, name: made.append(name) or write(df, name))
    few = rows(quality.quality_verdicts(docs_, "doc_id"), "doc_id", "kept", "distance")
    assert not {"medians", "mcd", "mcd-least"} & set(made)
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    many = rows(quality.quality_verdicts(docs_, "doc_id"), "doc_id", "kept", "distance")
    assert {"medians", "mcd", "mcd-least"} <= set(made)
    assert [r[:2] for r in few] == [r[:2] for r in many]
    assert np.allclose([r[2] for r in few], [r[2] for r in many])


def test_steps_on_few_estimates_take_few_tasks(spark, monkeypatch):
    """However many partitions a shuffle has, and the expression of a distance doesn't double with every statistic."""
    rng = random.Random(12)
    vectors = [("en" if i % 2 else None, *(rng.gauss(m, s) for m, s in ((5.0, 0.8), (1.7, 0.1), (0.5, 0.3), (0.3, 0.3), (0.4, 0.5)))) for i in range(400)]
    cells = quality.cells_of(spark.createDataFrame(vectors, "_lang string, " + ", ".join(f"x{i} double" for i in range(5))), ["_lang"])
    cells = spark.createDataFrame(cells.toArrow(), cells.schema)
    fixed = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.debug.maxToStringFields": "1000"}
    before = {k: spark.conf.get(k) for k in fixed}
    d = range(5)
    one = spark.range(1).selectExpr(*[f"rand() AS {c}" for c in [*(f"x{i}" for i in d), *(f"m{i}" for i in d), *(f"l{i}{j}" for i in d for j in range(i + 1))]])
    taken, held = [], quality._held
    few = quality.mcd_estimates(cells, ["_lang"])

    def counted(estimates, name, tasks):
        spark.sparkContext.setJobGroup(group := f"{name}-{len(taken)}", name)
        out, tracker = held(estimates, name, tasks), spark.sparkContext.statusTracker()
        taken.append(max(tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)))
        return out

    monkeypatch.setattr(quality, "_held", counted)
    try:
        for k, v in fixed.items():
            spark.conf.set(k, v)
        assert quality._distances(one)._jdf.queryExecution().optimizedPlan().toString().count("/ l00") <= 1
        same = quality.mcd_estimates(cells, ["_lang"])
        assert np.allclose([r[1:] for r in sorted(map(tuple, few.collect()), key=repr)], [r[1:] for r in sorted(map(tuple, same.collect()), key=repr)])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(taken) > 4
    assert max(taken[2:]) < 40  # after the medians and the starts


def test_quality(docs, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = sorted((repr(r[0]), *r[1:]) for r in rows(quality.quality_verdicts(docs, "doc_id"), "doc_id", *names))
    assert got == sorted((repr(i), *brute.statistics(t)) for i, t in DOCS)
    verdicts = quality.quality_verdicts(docs, "doc_id")
    assert not verdicts.filter("base_failed and kept").count()
    assert quality.accepted(docs).columns == docs.columns
    assert quality.quality_verdicts(empty, "doc_id").count() == 0


def test_outliers(spark):
    """In a group of like documents those full of signs are rejected, the others kept."""
    data = [(i, prose(RNG.randint(150, 400)), "en", "s") for i in range(120)] + [(500 + i, " ".join(w + "%%%" for w in prose(200).split()), "en", "s") for i in range(6)]
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string"), "doc_id").collect()}
    assert all(got[i] == (i < 500) for i in got)


def test_byte_bpe(docs, empty):
    path, pattern = byte_bpe.vocabulary()
    encode = byte_bpe._encoder(path, pattern).encode_ordinary
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(encode(t or "")), sha(np.array(encode(t or ""), "<u4").tobytes()), sha((t or "").encode())) for i, t in DOCS]
    assert rows(byte_bpe.digests(docs.select("doc_id", "text"), path, pattern), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert byte_bpe.digests(empty, path, pattern).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path)
    assert sorted(bytes(r.decoded).decode() for r in back.collect()) == sorted(t or "" for _, t in DOCS)


def test_byte_bpe_holds_little(monkeypatch):
    """A worker never holds a million characters for the class table, nor two blocks, nor the ids of a whole block twice."""
    tracemalloc.start()
    table = pretokens.class_table.__wrapped__()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (table == pretokens.class_table()).all()
    assert [table[ord(x)] for x in "aé7 !\u2028\U0001f600\U00020000"] == [pretokens.LETTER] * 2 + [pretokens.NUMBER, pretokens.BLANK, pretokens.OTHER, pretokens.BLANK, pretokens.OTHER, pretokens.LETTER]
    assert peak < 16 << 20

    alive, most, cuts = weakref.WeakSet(), [], []

    class Counted(byte_bpe.Block):
        def add(self, part):
            alive.add(self)
            most.append(len(alive))
            cuts.append(part.num_rows)
            super().add(part)

    class Docs:
        schema = {"_id": type("Field", (), {"dataType": type("Kind", (), {"simpleString": staticmethod(lambda: "bigint")})})}

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

        def __getattr__(self, name):
            return lambda *a: self

    monkeypatch.setattr(byte_bpe, "Block", Counted)
    monkeypatch.setattr(byte_bpe, "BLOCK", 1 << 19)
    monkeypatch.setattr(byte_bpe, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 3})())}))
    texts = [f"word{i} and {i % 7} more" * 60 for i in range(2500)]
    batch = pa.record_batch({"_id": pa.array(range(2500)), "_k": pa.array(range(2500)), "text": pa.array(texts)})
    places = list(byte_bpe.block_places(Docs())(iter([batch])))
    words = list(byte_bpe.block_words(Docs(), 5)(iter([batch])))
    assert len(places) == len(words) > 2
    assert max(most) == 1
    assert max(cuts) < 900  # half a MB at a time
    path, pattern = byte_bpe.vocabulary()
    encode = byte_bpe._encoder(path, pattern).encode_ordinary
    seen = 0
    for place, own in zip(places, words, strict=True):
        ids = list(byte_bpe.encoded_words(Docs(), path, pattern)(iter([own])))
        got = byte_bpe.put_together(pa.Table.from_batches([place]), pa.Table.from_batches(ids), path, True)
        assert all(len(x) <= byte_bpe.ROWS for x in got.to_batches())
        assert all(np.frombuffer(x, "<u4").tolist() == encode(texts[i]) and back.decode() == texts[i] for i, x, back in zip(*[got.column(c).to_pylist() for c in ("doc_id", "ids", "decoded")], strict=True))
        seen += got.num_rows
    assert seen == 2500


def test_pretokens():
    import public_tokenizers
    import regex

    ends = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    signs = list("  \n\t''''srtvemldab01é٣²…!,. 😀中")
    for _ in range(400):
        texts = ["".join(RNG.choices(signs, k=RNG.randint(0, 14))) for _ in range(4)]
        joined, codes, offsets = pretokens.code_points(texts)
        for cut, pattern in ((pretokens.byte_level_spans, public_tokenizers.PATTERN), (pretokens.word_end_spans, ends)):
            begins, stops = cut(codes, offsets)
            assert [joined[b:e] for b, e in zip(begins, stops, strict=True)] == [m for t in texts for m in regex.findall(pattern, t)]


def test_hashes_tell_words_apart():
    from ridgeline.llm import kernels

    hashes, offsets = kernels.spaced_words(pa.array(["A b\tb", None, "", "ab a"]), lower=True)
    assert offsets.tolist() == [0, 3, 3, 3, 5]
    assert hashes[1] == hashes[2]
    assert hashes[0] == hashes[4]
    assert len(set(hashes.tolist())) == 3


def test_very_long_texts(spark, tmp_path):
    """What stands at the end of a text of 40,000 words counts in every operator over texts; columns clash with inner names."""
    head, passage, item = prose(40_000), prose(70), prose(14)
    tail = f"{item} {passage} write zoe.roe@corp.com you gr0mbl@t"
    texts = [f"{head} {tail}", f"{head} {tail} end", f"{prose(40)} {passage} {prose(20)}", *[f"you gromblat fool {prose(20)}" for _ in range(12)], *[prose(30) for _ in range(20)]]
    names = "doc_id bigint, text string, lang string, source string, score double, fold int, toxic int, held_out int, comp long, digest string"
    docs_ = spark.createDataFrame([(i, t, "en", "s", 0.5, 1, 1, 1, 2, "d") for i, t in enumerate(texts)], names).repartition(3)
    data = list(enumerate(texts))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows(decontaminate.contamination(docs_, spark.createDataFrame([(1, item)], "item_id bigint, text string"), "doc_id"), *columns) == sorted(brute.contamination(data, [(1, item)]), key=repr)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_).collect()} == {i: min(i, 0) if i == 1 else i for i in range(len(texts))}
    found = language.identified(docs_).filter("doc_id = 0").first()
    assert (found.lang_pred, found.score) == ("en", 1.0)
    labels = spark.createDataFrame([(i, int(3 <= i < 15), "x") for i in range(3, len(texts))], "doc_id bigint, toxic int, text string")
    assert {r.doc_id for r in toxicity.toxicity(docs_, labels).filter("predicted = 1").collect()} == {0, 1, *range(3, 15)}
    masked = {r.doc_id: r.text for r in pii.replaced(docs_, "secret").collect()}
    assert masked[0].startswith(head)
    assert "corp.com" not in masked[0]
    covered = {}
    for r in repeats.repeats(docs_).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.begin, r.begin + r.words))
    assert covered == brute.repeated(data)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows(quality.quality_verdicts(docs_, "doc_id"), *columns) == sorted(((i, *brute.statistics(t)) for i, t in data), key=repr)
    path, pattern = byte_bpe.vocabulary()
    assert {r.doc_id: r.n_tokens for r in byte_bpe.digests(docs_, path, pattern).collect()} == {i: len(byte_bpe._encoder(path, pattern).encode_ordinary(t)) for i, t in data}
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.vocabulary())
    assert {r.doc_id: r.ids_crc32 for r in token_files.round_trip(docs_).collect()} == {i: brute.crc([*tok.encode(t, add_special_tokens=False).ids, 1]) for i, t in data}
