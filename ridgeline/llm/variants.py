"""Spelling variants: words one edit apart, found by the halves of words in Aho-Corasick automata.

An edit of one code point leaves one half of a word whole, at the beginning or the end of its variant. Shards of bounded
size hold automata over the halves of words, under the side of the half, the length of the word and the outer two code
points; the words that could hold such a half are scanned by the shard. A half found at its own end of a word whose length
fits is verified: the rest is one edit away from a rest that the shard holds with this half. Rests of a half are kept in
tables by one-character gaps, so that a half which very many words share costs no pairs but true ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, small_side, written

RUN = re.compile("[a-zÀ-ÿ]+")
#: About the most words whose halves one automaton holds, and the most that it scans in one task.
SHARD, SCANNED = 5_000, 100_000
#: Different words that a task counts before it hands them on.
COUNTED = 400_000
LEAST_LENGTH, LEAST_COUNT, SLIP = 5, 3, 97


def lower(text: str) -> str:
    """``text`` with only A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def slipped(word: str, start: int) -> str:
    """The word, or for one hash in 97 the word without one code point. ``start`` is the checksum of what comes before."""
    h = zlib.crc32(word.encode(), start)
    return word if h % SLIP else word[: h % len(word)] + word[h % len(word) + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column("doc_id"), batch.column("text")):
            doc, text = doc.as_py(), text.as_py()
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for word, n in Counter(RUN.findall(lower(text))).items() if text else ():
                total[slipped(word, start)] += n
            if len(total) > COUNTED:
                yield out()
                total.clear()
    yield out()


def words_of(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the distinct words of all texts with at least so many code points and occurrences."""
    counted = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n bigint").filter(F.length("word") >= least_length)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _route(side: int, length) -> object:
    """The key of the shards for one side, the length of the words that they hold, and the outer two code points of ``word``."""
    outer = F.substring("word", 1, 2) if side == 0 else F.substring("word", -2, 2)
    return F.concat_ws("|", F.lit(side), length.cast("string"), outer)


def _gaps(text: str) -> list[str]:
    return [f"{text[:p]}\n{text[p + 1 :]}" for p in range(len(text))]


class Shard:
    """The halves of some words in an automaton, with the rests of the words under each half."""

    def __init__(self, rows: Iterator[tuple[int, str, int]]) -> None:
        self.rests: dict[tuple[int, int, str], dict[str, tuple[str, int]]] = {}
        self.gaps: dict[tuple[int, int, str], dict[str, list[str]]] = {}
        self.halves = ahocorasick.Automaton()
        for side, word, n in rows:
            cut = len(word) // 2
            half, rest = (word[:cut], word[cut:]) if side == 0 else (word[cut:], word[:cut])
            key = side, len(word), half
            self.rests.setdefault(key, {})[rest] = word, n
            gaps = self.gaps.setdefault(key, {})
            for gap in _gaps(rest):
                gaps.setdefault(gap, []).append(rest)
            self.halves.add_word(half, half)
        self.halves.make_automaton()

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """The held words, as long as ``word`` or one shorter, that are one edit away and share a half; each from one side."""
        size = len(word)
        for end, half in self.halves.iter(word):
            if end == len(half) - 1:
                yield from self._verified(0, word, half, word[len(half) :])
            if end == size - 1:
                yield from self._verified(1, word, half, word[: size - len(half)])

    def _verified(self, side: int, word: str, half: str, rest: str) -> Iterator[tuple[str, int]]:
        alike = self.rests.get((side, len(word), half))
        if alike is not None:
            gaps = self.gaps[side, len(word), half]
            for gap in _gaps(rest):
                for other in gaps.get(gap, ()):
                    if other != rest:
                        yield alike[other]
        shorter = self.rests.get((side, len(word) - 1, half))
        if shorter is not None:
            for less in {rest[:p] + rest[p + 1 :] for p in range(len(rest))}:
                if less in shorter and not (side == 1 and word.startswith(less)):  # else found by its other half
                    yield shorter[less]


def _pairs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    held = rows[rows.side >= 0]
    if not len(held) or len(held) == len(rows):
        return pd.DataFrame({"word": [], "near": [], "near_n": []})
    shard = Shard(zip(held.side.tolist(), held.word.tolist(), held.n.tolist()))
    out: list[tuple[str, str, int]] = []
    for word, n in zip(*(rows.loc[rows.side < 0, c].tolist() for c in ("word", "n"))):
        for other, k in shard.near(word):
            out.append((word, other, k))
            if len(other) < len(word):
                out.append((other, word, n))
    return pd.DataFrame(out, columns=["word", "near", "near_n"])


def near_words(words: DataFrame, shard: int = SHARD, scanned: int = SCANNED) -> DataFrame:
    """(word, near, near_n): all ordered pairs of ``words`` (word, n; each word once, of 2 code points at least) one edit apart."""
    size = F.length("word")
    held = reduce(DataFrame.unionByName, [words.select("word", "n", F.lit(side).alias("side"), _route(side, size).alias("route")) for side in (0, 1)])
    scans = words.select("word", "n", F.explode(F.array(*(_route(side, size - less) for side in (0, 1) for less in (0, 1)))).alias("route"))
    asked = scans.groupBy("route").agg(F.count(F.lit(1)).alias("m"))
    # A route with many words gets shards of its own, as many as they fill; the others share shards.
    routes = held.groupBy("route").agg(F.count(F.lit(1)).alias("k")).join(asked, "route", "left")
    routes = written(routes.select("route", F.ceil(F.col("k") / shard).alias("subs"), F.ceil(F.coalesce("m", F.lit(1)) / scanned).alias("blocks"), "k"), "routes")
    filled = routes.filter((F.col("subs") == 1) & (F.col("blocks") == 1)).agg(F.sum("k")).first()[0] or 0
    bins = max(1, -(-filled // shard))
    alone = (F.col("subs") > 1) | (F.col("blocks") > 1)
    name = F.when(alone, F.col("route")).otherwise(F.pmod(F.xxhash64("route"), F.lit(bins)).cast("string"))
    side = small_side(routes.select("route", name.alias("shard"), "subs", "blocks"), "route")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    mine = lambda n, seed: F.pmod(F.xxhash64("word", F.lit(seed)), F.col(n)).cast("int")
    stored = held.join(side, "route").select("shard", mine("subs", 1).alias("sub"), each("blocks").alias("block"), "side", "word", "n")
    looked = scans.join(side, "route").select("shard", "word", "n", mine("blocks", 2).alias("block"), each("subs").alias("sub")).distinct()
    rows = stored.unionByName(looked.withColumn("side", F.lit(-1)))
    pairs = written(rows.groupBy("shard", "sub", "block").applyInPandas(_pairs, "word string, near string, near_n bigint"), "near_words")
    dropped(routes)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain word, form, form of the form ... of every word of ``forms`` (word, form), by doubling."""
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.filter("moved").isEmpty():
        step = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = written(now.join(step, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        dropped(now)
        now = new
    return now.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, shard: int = SHARD, scanned: int = SCANNED) -> DataFrame:
    """Every frequent word of the texts with its accepted form: word, n, n_near, form, form_n, root.

    ``docs`` needs doc_id and text; other columns are not looked at. A null text holds no words, a null doc_id counts as an
    empty one, rows that repeat a doc_id each count. The form of a word is its near word of largest n (ties: the smallest in
    code-point order) if that is twice the word's n or more; the root is where forms lead at last, the word itself without
    one. Texts and runs of letters may be of any length. Without words the result is empty.
    """
    words = written(words_of(docs, least_length, least_count), "words")
    pairs = near_words(words, shard, scanned)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))).alias("best"))
    judged = words.join(best, "word", "left").withColumn("twice", F.coalesce(-F.col("best.m") >= 2 * F.col("n"), F.lit(False)))
    judged = judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("twice"), F.col("best.form")).alias("form"), F.when(F.col("twice"), -F.col("best.m")).alias("form_n"))
    judged = written(judged, "forms")
    dropped(pairs, words)
    return judged.join(roots(judged.filter("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
