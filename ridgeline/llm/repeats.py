"""Operator 8, suffix-array dedup: passages that occur in several documents, by a sparse suffix array.

Of each run of ``WINDOW`` word positions the one with the least hash of its words is kept (content decides, so equal
passages keep the same positions); the suffixes at these positions are sorted over the whole corpus and each is compared
with its neighbours. A passage of ``LEAST`` words always holds a kept position with ``DEPTH`` words of the passage to its
right, so equal passages meet under one key. Neighbours are taken in the order of the words that follow and in that of the
words that come before the key, one word after another, and every match is extended word by word to both sides in the texts
themselves. Under a key of more than two suffixes equal passages need not be neighbours on either side, so there all
windows of ``LEAST`` words that the kept positions stand for are joined by a 64-bit hash of their words.

Equal texts are one class and travel once; a class goes by 64 bits of its text, and texts that meet there by chance, told apart
by 64 further bits, get numbers of their own. Edge cases: null and empty texts and texts of fewer than ``LEAST`` words repeat
nothing; equal rows repeat each other whole; a row without an id is reported without one; empty tables give no rows;
further columns are ignored; there is no limit on the length of a text or of a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .neardup import bit_filter, hits
from .scratch import small_side, written

LEAST, WINDOW = 50, 25
DEPTH = LEAST - WINDOW + 1
GRAM = 8
#: Words behind the key, and before the position, that order the suffixes, by a byte of hash for each.
AROUND = LEAST - DEPTH
#: Makes the second hash of a window.
SECOND = np.uint64(0xA5A5F00D12345677)
_INDEX = 24


def kept_positions(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, text, start, windows): the positions that are least in a window, of all texts whose words are on end.

    Each stands for ``windows`` consecutive windows of LEAST words, the first of which begins at ``start``.
    """
    sizes = np.diff(texts)
    n_windows = np.maximum(sizes - LEAST + 1, 0)
    if not n_windows.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at = np.arange(len(words) - GRAM + 1)
    grams = kernels.span_hashes(words, at, at + GRAM)
    ranked = (grams >> np.uint64(_INDEX) << np.uint64(_INDEX)) | (at.astype(np.uint64) & np.uint64((1 << _INDEX) - 1))
    least, have = ranked, 1
    while have < WINDOW:
        step = min(have, WINDOW - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    text_of = np.repeat(np.arange(len(sizes)), n_windows)
    starts = texts[:-1][text_of] + np.arange(len(text_of)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    found = least[starts]
    begin = np.concatenate(([True], (found[1:] != found[:-1]) | (text_of[1:] != text_of[:-1])))
    stands = np.diff(np.append(np.flatnonzero(begin), len(found)))
    found, text_of, starts = found[begin], text_of[begin], starts[begin]
    low = (found & np.uint64((1 << _INDEX) - 1)).astype(np.int64)
    position = (starts >> _INDEX << _INDEX) | low
    return np.where(position < starts, position + (1 << _INDEX), position), text_of, starts, stands


def words_in_order(words: np.ndarray, first: np.ndarray, step: int, inside: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """A byte for each of the AROUND words from ``first`` on, by ``step``; 0 outside of the text from ``inside[0]`` to ``inside[1]``."""
    at = first[:, None] + step * np.arange(AROUND)
    fits = (at >= inside[0][:, None]) & (at < inside[1][:, None])
    signs = np.where(fits, (words >> np.uint64(56)).astype(np.uint8)[np.clip(at, 0, len(words) - 1)] | 1, 0).astype(np.uint8) if len(first) else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.arange(len(first) + 1, dtype=np.int32) * AROUND), pa.py_buffer(np.ascontiguousarray(signs))])


def suffix_rows(part: pa.RecordBatch, bits: np.ndarray | None) -> dict[str, np.ndarray | pa.Array]:
    """The kept suffixes of a chunk of texts: key, class of the text, place, and the words that order them."""
    words, texts = kernels.spaced_words(part.column("text"), lower=True)
    at, text, _, _ = kept_positions(words, texts)
    key = kernels.span_hashes(words, at, at + DEPTH)
    if bits is not None and len(at):
        chosen = hits(bits, key)
        at, text, key = at[chosen], text[chosen], key[chosen]
    rows = {"key": key.view(np.int64), "c": part.column("c").to_numpy(zero_copy_only=False)[text] if len(at) else np.zeros(0, np.int64), "pos": at - texts[:-1][text]}
    if bits is not None:
        inside = texts[:-1][text], texts[1:][text]
        rows |= {"r": words_in_order(words, at + DEPTH, 1, inside), "l": words_in_order(words, at - 1, -1, inside)}
    return rows


def shared_suffixes(docs: DataFrame) -> DataFrame:
    """The kept suffixes whose keys occur more than once; docs: (c, text)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.chunks(batch):
                rows = suffix_rows(part, None)
                found, n = np.unique(rows["key"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int32))], ["key", "n"])

    counted = docs.mapInArrow(keys, "key long, n int").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(written(counted, "shared-keys"), "key"))
    names = ["key", "c", "pos", "r", "l"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.chunks(batch):
                rows = suffix_rows(part, bits.value)
                yield pa.RecordBatch.from_arrays([pa.array(rows[x]) for x in names], names)

    out = written(docs.mapInArrow(run, "key long, c long, pos long, r binary, l binary").distinct(), "suffixes")
    bits.destroy()
    return out


def shared_windows(docs: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(c, begin, words, other): the passages that repeat under keys of more than two suffixes, by an exact join on windows; docs: (c, text)."""
    frequent = suffixes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").select("key")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(frequent, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.chunks(batch):
                words, texts = kernels.spaced_words(part.column("text"), lower=True)
                at, text, start, stands = kept_positions(words, texts)
                if not len(at):
                    continue
                chosen = hits(bits.value, kernels.span_hashes(words, at, at + DEPTH))
                text, start, stands = text[chosen], start[chosen], stands[chosen]
                begin = np.repeat(start - (np.cumsum(stands) - stands), stands) + np.arange(stands.sum())
                text = np.repeat(text, stands)
                c = part.column("c").to_numpy(zero_copy_only=False)[text]
                # two hashes of 64 bits: one would be shared by some unlike windows among very many
                hashes = [kernels.span_hashes(w, begin, begin + LEAST).view(np.int64) for w in (words, kernels.mixed(words ^ SECOND))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, hashes), pa.array(c), pa.array(begin - texts[:-1][text])], ["h", "g", "c", "begin"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, other, begin = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("c", "other", "begin"))
            if not len(c):
                continue
            first = np.concatenate(([True], (c[1:] != c[:-1]) | (other[1:] != other[:-1]) | (begin[1:] > begin[:-1] + 1)))
            last = np.concatenate((first[1:], [True]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c[first], begin[first], begin[last] - begin[first] + LEAST, other[first])], ["c", "begin", "words", "other"])

    rows = written(docs.mapInArrow(run, "h long, g long, c long, begin long"), "windows")
    bits.destroy()
    shared = rows.groupBy("h", "g").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high")
    met = rows.join(shared, ["h", "g"]).select("c", "begin", F.when(F.col("c") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("other"))
    return met.repartition("c").sortWithinPartitions("c", "other", "begin").mapInArrow(joined, "c long, begin long, words long, other long")


def neighbours(suffixes: DataFrame, side: str) -> DataFrame:
    """(a, pa, b, pb): each suffix with the one before it, in sorted order, that has the same key and is of another class.

    The sorted suffixes are dealt by ranges; the first and last of each range are compared in a second, small step.
    """
    order = ["key", side, "c", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, first = TaskContext.get().partitionId(), None, None
        for batch in batches:
            key, c, pos = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("key", "c", "pos"))
            if last is not None:
                key, c, pos = (np.concatenate((x, y)) for x, y in zip(last, (key, c, pos), strict=True))
            elif len(key):
                first = (key[0], c[0], pos[0])
            if not len(key):
                continue
            change = np.concatenate(([True], (key[1:] != key[:-1]) | (c[1:] != c[:-1])))
            starts = np.maximum.accumulate(np.where(change, np.arange(len(key)), 0))
            before = starts - 1
            fits = (before >= 0) & (key[np.maximum(before, 0)] == key)
            if last is not None:
                fits[: len(last[0])] = False
            yield _links(c[fits], pos[fits], c[before[fits]], pos[before[fits]], 0, key[fits])
            tail = int(starts[-1]) - 1 if starts[-1] > 0 and key[starts[-1] - 1] == key[-1] else int(starts[-1])
            keep = np.unique([tail, int(starts[-1]), len(key) - 1])
            last = key[keep], c[keep], pos[keep]
        if last is not None:
            ends = [first, *zip(*(x[-1:] for x in last), strict=True)]
            yield _links(*[np.array([e[i] for e in ends]) for i in (1, 2)], *[np.array([part, part]) for _ in range(2)], 1, np.array([e[0] for e in ends]))

    rows = suffixes.select(*order)
    n = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, "a long, pa long, b long, pb long, edge int, key long"), "neighbours")
    seam = Window.partitionBy(F.lit(0)).orderBy("b", "at")  # two rows a range
    edges = found.filter("edge = 1").select("key", "a", "pa", "b", F.monotonically_increasing_id().alias("at"))
    across = edges.select("a", "pa", "key", *[F.lag(x).over(seam).alias(f"_{x}") for x in ("a", "pa", "key")]).filter("key = _key and a <> _a")
    return found.filter("edge = 0").select("a", "pa", "b", "pb").unionByName(across.select("a", "pa", F.col("_a").alias("b"), F.col("_pa").alias("pb")))


def _links(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray, edge: int, key: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int64)) for x in (a, pa_, b, pb)], pa.array(np.full(len(a), edge, np.int32)), pa.array(key.astype(np.int64))], ["a", "pa", "b", "pb", "edge", "key"])


def extended(x: np.ndarray, y: np.ndarray, places: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(begin in x, begin in y, words) of the maximal equal runs of at least LEAST words through the matched places."""
    done: dict[int, list[tuple[int, int]]] = {}
    for p, q in sorted(places):
        shift = q - p
        if any(b <= p < e for b, e in done.get(shift, ())):
            continue
        low, high = max(0, -shift), min(len(x), len(y) - shift)
        differ = np.flatnonzero(x[low:high] != y[low + shift : high + shift]) + low
        k = int(np.searchsorted(differ, p))
        begin = int(differ[k - 1]) + 1 if k else low
        end = int(differ[k]) if k < len(differ) else high
        done.setdefault(shift, []).append((begin, max(end, p + 1)))
        if end - begin >= LEAST:
            yield begin, begin + shift, end - begin


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(c, begin, words, other): the repeated passages of every class of texts and a class that shares each; docs: (c, text)."""
    suffixes = shared_suffixes(docs)
    pairs = neighbours(suffixes, "r").unionByName(neighbours(suffixes, "l"))
    flip = F.col("a") > F.col("b")
    pairs = pairs.select(*[F.when(flip, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("pa", "pb"), ("b", "a"), ("pb", "pa"))])
    pairs = written(pairs.groupBy("a", "b").agg(F.collect_set(F.struct("pa", "pb")).alias("places")), "repeat-pairs")
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "repeat-classes")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(ends, "c"))

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(hits(bits.value, batch.column("c").to_numpy(zero_copy_only=False))))
            packed = [pa.compress(x.encode(), codec="zstd", asbytes=True) for x in own.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([own.column("c"), pa.array(packed, pa.binary()), pc.binary_length(own.column("text")).cast(pa.int64())], ["c", "packed", "size"])

    texts = docs.mapInArrow(carried, "c long, packed binary, size long").join(ends, "c", "left_semi").dropDuplicates(["c"])
    texts = written(texts, "repeat-texts")
    bits.destroy()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def words(packed: bytes, size: int) -> np.ndarray:
            return kernels.spaced_words(pa.array([pa.decompress(packed, size, codec="zstd", asbytes=True).decode()], pa.large_string()), lower=True)[0]

        for batch in batches:
            out = []
            for a, b, ta, tb, sa, sb, places in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb", "sa", "sb", "places")], strict=True):
                if a not in held:  # rows come sorted by a
                    held = {a: words(ta, sa)}
                for begin, other, n in extended(held[a], words(tb, sb), [(p["pa"], p["pb"]) for p in places]):
                    out += [(a, begin, n, b), (b, other, n, a)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], ["c", "begin", "words", "other"])

    one = pairs.join(texts.select(F.col("c").alias("b"), F.col("packed").alias("tb"), F.col("size").alias("sb")), "b")
    both = one.join(texts.select(F.col("c").alias("a"), F.col("packed").alias("ta"), F.col("size").alias("sa")), "a")
    found = both.select("a", "b", "ta", "tb", "sa", "sb", "places").mapInArrow(compared, "c long, begin long, words long, other long")
    return found.unionByName(shared_windows(docs, suffixes))


def text_keys() -> list[Column]:
    """128 bits of a text, in two columns."""
    return [F.xxhash64("text").alias("c"), F.xxhash64(F.lit(1), "text").alias("c2")]


def told_apart(ids: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ids and rows (c, c2) with another ``c`` for all but one of different texts under one ``c``; next to never there are any."""
    meet = ids.groupBy("c").agg(F.min("c2").alias("own"), F.max("c2").alias("other")).filter("own <> other").select("c", "own")
    moved = written(ids.join(meet, "c").filter("c2 <> own").select("c", "c2").distinct().withColumn("new", F.xxhash64("c", "c2", F.lit("apart"))), "apart")
    if moved.isEmpty():
        return ids, rows
    moved = small_side(moved)
    return tuple(x.join(moved, ["c", "c2"], "left").withColumn("c", F.coalesce("new", "c")).drop("new") for x in (ids, rows))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, begin, words, shared_with): the maximal stretches of every document that repeat, by word positions.

    Overlapping stretches are one; ``shared_with`` is the smallest doc_id met in it (the document's own, if it is
    the first of equal texts). docs: doc_id, text.
    """
    n_words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    rows = docs.filter("text is not null").select("doc_id", *text_keys(), "text")
    ids = written(rows.select("doc_id", "c", "c2", n_words.cast("long").alias("n")), "repeat-ids")
    ids, rows = told_apart(ids, rows)
    found = written(repeated_spans(rows.select("c", "text")), "repeat-spans")
    classes = ids.groupBy("c").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"))
    named = found.join(classes.select(F.col("c").alias("other"), F.col("first").alias("id")), "other").select("c", "begin", (F.col("begin") + F.col("words")).alias("end"), "id")
    whole = classes.filter((F.col("copies") > 1) & (F.col("n") >= LEAST)).select("c", F.lit(0).cast("long").alias("begin"), F.col("n").alias("end"), F.col("first").alias("id"))
    w = Window.partitionBy("c").orderBy("begin", "end")
    spans = named.unionByName(whole).withColumn("_reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("_group", F.sum((F.col("_reach").isNull() | (F.col("begin") > F.col("_reach"))).cast("int")).over(w))
    merged = spans.groupBy("c", "_group").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("id").alias("id"))
    out = ids.select("doc_id", "c").join(written(merged, "repeat-merged"), "c")  # two plain sides: a hot class can be split
    return out.select("doc_id", "begin", (F.col("end") - F.col("begin")).alias("words"), F.col("id").alias("shared_with"))
