"""Ranked lexical search by sort-based accumulation.

Documents are cut once; of each only its number of terms and the (term, frequency) pairs of terms that some item asks for
are kept, as a table of postings. Frequencies over all documents give integer weights. Then the postings are dealt by
ranges of documents, so that all impacts of a pair of item and document lie in one task: a task puts the matched (item,
document, impact) arrays on end, radix sorts their packed keys, sums runs by ``reduceat``, and keeps a heap of the best k
of each item. What the tasks keep, k rows an item each, is ranked at last.

The terms of items travel to the tasks in blocks of bounded size, checked beforehand; more items than a block holds take
more passes over the documents, one a block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .kernels import ascii_lower, chunks, runs, span_hashes, utf8
from .scratch import BROADCAST_BYTES, dropped, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Matched pairs that a task sorts at once.
AT_ONCE = 1 << 20


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each pair once; rows of one item_id are one item."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select("item_id", F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def _blocks(terms: DataFrame, most: int) -> list[DataFrame]:
    """Parts of ``terms``, whole items each, within ``most`` bytes unless a single item is larger."""
    n, size, items = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term") + 24), F.lit(0)), F.count_distinct(F.xxhash64("item_id"))).first()
    if not n:
        return []
    parts = 1
    while parts < 64 * items:
        by = terms.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("p")).agg(F.sum(F.octet_length("term") + 24).alias("size"), F.count_distinct(F.xxhash64("item_id")).alias("items"))
        if size <= most or by.filter((F.col("size") > most) & (F.col("items") > 1)).isEmpty():
            break
        parts *= 2
    return [terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p) for p in range(parts)]


class _Asked:
    """The terms of a block of items as arrays: ordered by hash, with their bytes on end and the items of each."""

    def __init__(self, rows: list) -> None:
        terms = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
        raw = [t.encode() for t in terms]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.array([len(x) for x in raw], np.int64)
        begins = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        hashes = span_hashes(self.bytes, begins, begins + lengths)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.begins, self.lengths = hashes[order], begins[order], lengths[order]
        self.alike = int(np.unique(self.hashes, return_counts=True)[1].max())
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids = list(dict.fromkeys(r.item_id for r in rows))
        number = {x: i for i, x in enumerate(self.ids)}
        pairs = sorted((place[terms[r.term]], number[r.item_id]) for r in rows)
        self.items = np.array([p[1] for p in pairs], np.int64)
        self.starts = np.searchsorted(np.array([p[0] for p in pairs]), np.arange(len(order) + 1))

    def match(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The asked term that each span is, byte for byte, or -1."""
        found = np.full(len(begins), -1, np.int64)
        at, hashes = np.searchsorted(self.hashes, h := span_hashes(data, begins, ends)), h
        for k in range(self.alike):
            p = np.minimum(at + k, len(self.hashes) - 1)
            maybe = np.flatnonzero((self.hashes[p] == hashes) & (self.lengths[p] == ends - begins) & (found < 0))
            if not len(maybe):
                continue
            n = self.lengths[p[maybe]]
            first = np.concatenate(([0], np.cumsum(n)[:-1]))
            inner = np.arange(n.sum()) - np.repeat(first, n)
            same = data[np.repeat(begins[maybe], n) + inner] == self.bytes[np.repeat(self.begins[p[maybe]], n) + inner]
            good = maybe[np.logical_and.reduceat(same, first)]
            found[good] = p[good]
        return found


def _term_bytes() -> np.ndarray:
    inside = np.ones(256, bool)
    for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        inside[low : high + 1] = False
    return inside


def _postings(asked) -> object:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, inside = asked.value, _term_bytes()
        for batch in batches:
            for part in chunks(batch):
                data, offsets = utf8(part.column("text"))
                data = ascii_lower(data)
                begins, ends, counts = runs(inside[data], offsets)
                term = q.match(data, begins, ends)
                doc = np.repeat(np.arange(part.num_rows), np.diff(counts))
                keys, tf = np.unique(doc[term >= 0] * len(q.hashes) + term[term >= 0], return_counts=True)
                cuts = pa.array(np.searchsorted(keys, np.arange(part.num_rows + 1) * len(q.hashes)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(counts), pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(keys % len(q.hashes), pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(tf, pa.int32()))],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    return task


def _counts(size: int) -> object:
    """Partial counts: documents by term; under -1 documents with a term, under -2 all terms."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            documents, total = documents + int((n > 0).sum()), total + int(n.sum())
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        keys = np.concatenate(([-1, -2], np.flatnonzero(df)))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(np.concatenate(([documents, total], df[df > 0])), pa.int64())], names=["term", "k"])

    return task


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative integers, 16 bits a pass from the lowest on."""
    order, top = np.arange(len(keys)), int(keys.max(initial=0))
    for shift in range(0, top.bit_length(), 16):
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def _best(asked, weights, k: int, kind: pa.DataType) -> object:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, (weight, documents, total) = asked.value, weights.value
        fan = np.diff(q.starts)
        heaps: list[list[tuple[int, int]]] = [[] for _ in q.ids]
        least = np.ones(len(q.ids), np.int64)
        for batch in batches:
            lists = batch.column("terms")
            cuts, n = lists.offsets.to_numpy().astype(np.int64), batch.column("n").to_numpy()
            terms, tfs = lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy().astype(np.int64)
            ids = batch.column("doc_id").to_pylist()
            cuts = cuts - cuts[0]
            entries = np.concatenate(([0], np.cumsum(fan[terms])))[cuts]
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(entries, entries[begin] + AT_ONCE, "right")) - 1)
                a, b = cuts[begin], cuts[end]
                doc = np.repeat(np.arange(end - begin), np.diff(cuts[begin : end + 1]))
                m = 10 + 90 * n[begin:end] * documents // total if total else n[begin:end]
                impact = weight[terms[a:b]] * (1_000_000_000 * tfs[a:b] // (1000 * tfs[a:b] + 8 * m[doc]))
                times = fan[terms[a:b]]
                inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                item = q.items[np.repeat(q.starts[terms[a:b]], times) + inner]
                width = max(1, (end - begin - 1).bit_length())
                keys = item << width | np.repeat(doc, times)
                order = radix_order(keys)
                keys = keys[order]
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
                sums = np.add.reduceat(np.repeat(impact, times)[order], first) if len(first) else np.zeros(0, np.int64)
                item, doc = keys[first] >> width, keys[first] & ((1 << width) - 1)
                good = sums >= least[item]
                item, doc, sums = item[good], doc[good], sums[good]
                edges = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1], [True]))) if len(item) else np.zeros(1, np.int64)
                for s, e in zip(edges[:-1], edges[1:]):
                    i = int(item[s])
                    more = ((int(v), -(2**64) if (x := ids[begin + d]) is None else -x) for v, d in zip(sums[s:e], doc[s:e]))
                    heaps[i] = heapq.nlargest(k, [*heaps[i], *more])
                    least[i] = heaps[i][-1][0] if len(heaps[i]) == k else 1
                begin = end
        kept = [(i, -d if d > -(2**64) else None, v) for i, heap in enumerate(heaps) for v, d in heap]
        for s in range(0, len(kept), 10_000):
            i, d, v = zip(*kept[s : s + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array([q.ids[x] for x in i], kind), pa.array(d, pa.int64()), pa.array(v, pa.int64())], names=["item_id", "doc_id", "score"])

    return task


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score.

    ``docs`` needs doc_id (an integer) and text, ``items`` item_id and text; other columns are not looked at. A null or
    termless text counts for nothing and is never found; an item without terms, or whose terms are in no document, has no
    rows, and so have all items if there are no documents. Rows of ``items`` with the same item_id, null included, are one
    item. Each row of ``docs`` is a document: rows that repeat a doc_id take a rank each. Equal scores go by ascending
    doc_id, a null one last. Texts may be of any length: they are cut whole, a few MB at a time.
    """
    spark = docs.sparkSession
    kind, name = to_arrow_type(items.schema["item_id"].dataType), items.schema["item_id"].dataType.simpleString()
    terms = written(item_terms(items), "item_terms")
    found = []
    for block in _blocks(terms, block_bytes):
        rows = block.collect()
        if not rows:
            continue
        asked = spark.sparkContext.broadcast(_Asked(rows))
        size = len(asked.value.hashes)
        postings = written(docs.select("doc_id", "text").mapInArrow(_postings(asked), "doc_id bigint, n bigint, terms array<int>, tfs array<int>").withColumn("place", F.monotonically_increasing_id()), "rank_postings")
        counts = {r.term: r.k for r in postings.select("n", "terms").mapInArrow(_counts(size), "term int, k bigint").groupBy("term").agg(F.sum("k").alias("k")).collect()}
        documents, total = counts.get(-1, 0), counts.get(-2, 0)
        df = np.array([counts.get(t, 0) for t in range(size)], np.float64)
        weights = spark.sparkContext.broadcast((np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64), documents, total))
        dealt = postings.repartitionByRange(F.col("doc_id").asc_nulls_last(), "place").select("doc_id", "n", "terms", "tfs")
        found.append(written(dealt.mapInArrow(_best(asked, weights, k, kind), f"item_id {name}, doc_id bigint, score bigint"), "rank_best"))
        dropped(postings)
    dropped(terms)
    if not found:
        return spark.createDataFrame([], f"item_id {name}, rank int, doc_id bigint, score bigint")
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")
