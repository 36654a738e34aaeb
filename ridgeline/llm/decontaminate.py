"""Operator 1, benchmark decontamination: a positional inverted index over the training words, in DataFrame functions only.

Windows of consecutive benchmark words are looked up as phrases: a first pass counts the corpus frequency of every test
term, a second one stores the postings (document, position) of the rarest terms of the windows, and the offset-adjusted
lists are intersected from the rarest term on. The postings of the rarest term carry the words around them, so the
remaining words are compared without going back to the texts: in place for phrases, and in any order within the reach of the
window for proximity matches.

Edge cases: null and empty texts have no words; an item without words has no window, one with fewer than ``width`` words
has one; repeated items share their windows; an item without an id marks words but is not listed; repeated documents get
the same result each; empty tables give no hits; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fits, small_side, written

WIDTH = 10
#: Terms of a window whose lists are intersected.
RAREST = 3
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, with A-Z in lower case. Texts of ASCII alone take the quicker function."""
    whole = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    return F.array_remove(F.split(lower, BREAK), "")


def windows_of(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window, words, item) of every item: its runs of ``width`` words, or all its words if they are fewer."""
    split = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - width, F.lit(0))), lambda i: F.slice("_w", i + 1, width))
    return split.select("item", F.explode(runs).alias("words")).select(F.array_join("words", " ").alias("window"), "words", "item").distinct()


def keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, words): a document goes by a hash of its id and text, so that rows without an id or with a repeated one are told apart."""
    return docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2"), words_of(F.col("text")).alias("_words"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of ``terms`` occurs in the documents."""
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return tokens.join(small_side(terms, "term"), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def postings(docs: DataFrame, terms: DataFrame, width: int = WIDTH) -> DataFrame:
    """(term, k1, k2, pos, at, around): the positions of ``terms`` (term, anchor); for anchors, the words up to ``width`` - 1 away.

    ``at`` is the index of the term in ``around``. While the terms fit a broadcast, a document's words wait beside its tokens;
    else tokens are joined alone, and only the documents with anchors are asked for their words.
    """
    first = F.greatest(F.col("pos") - (width - 1), F.lit(0))
    around = F.when(F.col("anchor"), F.slice("_words", first + 1, F.col("pos") - first + width))
    out = ["term", "k1", "k2", "pos", (F.col("pos") - first).alias("at")]
    if fits(terms, "term"):
        tokens = keyed(docs).select("k1", "k2", "_words", F.posexplode("_words").alias("pos", "term"))
        return tokens.join(F.broadcast(terms), "term").select(*out, around.alias("around"))
    held = written(keyed(docs).select("k1", "k2", F.posexplode("_words").alias("pos", "term")).join(terms, "term"), "held-postings")
    whole = keyed(docs).dropDuplicates(["k1", "k2"]).select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), "_words")
    anchors = held.filter("anchor").join(whole, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")))
    return anchors.select(*out, around.alias("around")).unionByName(held.filter("not anchor").select(*out, F.lit(None).cast("array<string>").alias("around")))


def rarest_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, words, lists): of each window whose terms all occur, the rarest terms with their offsets, rarest first."""
    placed = windows.select("window", "words").distinct().select("window", "words", F.posexplode("words").alias("off", "term"))
    ranked = placed.join(counts, "term").groupBy("window").agg(F.first("words").alias("words"), F.sort_array(F.collect_list(F.struct("n", "off", "term"))).alias("lists"))
    return ranked.filter(F.size("lists") == F.size("words")).select("window", "words", F.slice("lists", 1, RAREST).alias("lists"))


def candidates(docs: DataFrame, windows: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The postings of the windows' rarest terms, and every posting of a window's rarest one with the window."""
    distinct = windows.select("window", "words").distinct()
    terms = distinct.select(F.explode("words").alias("term")).distinct()
    plans = written(rarest_terms(distinct, term_counts(docs, terms)), "windows")
    needed = written(plans.select(F.posexplode("lists").alias("rank", "x")).groupBy("x.term").agg(F.max(F.col("rank") == 0).alias("anchor")), "terms")
    index = written(postings(docs, needed, width), "postings")
    first = plans.select("window", "words", "lists", F.col("lists")[0]["term"].alias("term"), F.col("lists")[0]["off"].alias("off"))
    return index, index.filter(F.col("around").isNotNull()).join(small_side(first, "window", 512), "term")


def phrases_among(index: DataFrame, found: DataFrame, width: int = WIDTH) -> DataFrame:
    """(k1, k2, window, start, len): the candidates where the whole window stands in order."""
    found = found.select("k1", "k2", "window", "words", "lists", (F.col("pos") - F.col("off")).alias("start"), (F.col("at") - F.col("off")).alias("begin"), "around")
    found = found.filter((F.col("start") >= 0) & (F.col("begin") >= 0))
    for rank in range(1, RAREST):
        of = index.select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), F.col("term").alias("_t"), F.col("pos").alias("_p"))
        item = F.col("lists")[rank]
        long = found.filter(F.size("lists") > rank)
        on = (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")) & (item["term"] == F.col("_t")) & (F.col("start") + item["off"] == F.col("_p"))
        found = long.join(of, on, "left_semi").unionByName(found.filter(F.size("lists") <= rank)) if width > rank else found
    exact = found.filter(F.slice("around", F.col("begin") + 1, F.size("words")) == F.col("words"))
    return exact.select("k1", "k2", "window", "start", F.size("words").alias("len")).distinct()


def near_among(found: DataFrame) -> DataFrame:
    """(k1, k2, window, pos): the candidates with all words of the window, each as often as in it, around the rarest one at ``pos``."""
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    near = found.filter(F.size(F.array_except("words", "around")) == 0).filter(F.forall(F.array_distinct("words"), lambda w: times(F.col("around"), w) >= times(F.col("words"), w)))
    return near.select("k1", "k2", "window", "pos").distinct()


def phrase_matches(docs: DataFrame, windows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(k1, k2, window, start, len): every occurrence of a window in a document."""
    return phrases_among(*candidates(docs, windows, width), width)


def proximity_matches(docs: DataFrame, windows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(k1, k2, window, pos): places of a window's rarest term with all its other words, in any order, less than ``width`` words away."""
    return near_among(candidates(docs, windows, width)[1])


def contamination(docs: DataFrame, items: DataFrame, *keep: str, width: int = WIDTH) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256, contaminated and n_near of every document, beside the columns ``keep``.

    ``n_near`` is the number of different windows with a proximity match, those that occur as phrases included.
    """
    windows = written(windows_of(items, width), "benchmark-windows")
    index, found = candidates(docs, windows, width)
    hits = written(phrases_among(index, found, width), "hits")
    near = near_among(found).select("k1", "k2", "window").distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_near"))
    marked = hits.select("k1", "k2", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos")).distinct()
    marked = marked.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_hit"))
    of = hits.select("k1", "k2", "window").distinct().join(windows.select("window", "item").filter("item is not null"), "window")
    listed = of.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = near.join(marked.join(listed, ["k1", "k2"], "left"), ["k1", "k2"], "left").withColumnsRenamed({"k1": "_1", "k2": "_2"})
    rows = docs.select(
        F.struct(*[F.col(k) for k in keep]).alias("_row"), F.xxhash64("doc_id", "text").alias("_a"), F.xxhash64("text", "doc_id").alias("_b"),
        F.size(words_of(F.col("text"))).cast("long").alias("n_words"),
    )
    whole = rows.join(found, (F.col("_a") == F.col("_1")) & (F.col("_b") == F.col("_2")), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return whole.select(
        "_row.*", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs in which no window occurs, with their columns."""
    hits = phrase_matches(docs, windows_of(items, width), width).select(F.col("k1").alias("_1"), F.col("k2").alias("_2")).distinct()
    on = (F.xxhash64(docs["doc_id"], docs["text"]) == F.col("_1")) & (F.xxhash64(docs["text"], docs["doc_id"]) == F.col("_2"))
    return docs.join(hits, on, "left_anti")
