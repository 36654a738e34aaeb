"""Operator 10, byte-level BPE by a global shuffle of distinct words; decoding joins the token-byte table.

Every task cuts its texts into pre-tokens and gathers them into blocks. A block lists its distinct words and holds, for
each position, the number of the word in that list. The words of all blocks are shuffled by word, each distinct one is
encoded once, and the ids go back to the blocks, where the texts are put together again by position. Decoding looks every
id up in the token-byte table, whose size is that of the vocabulary file.

Both passes cut the same scan into the same blocks; a block's key holds a digest of its rows, so if the input were to
change between them the job fails instead of losing rows. Feed it a table that is read from files.

Edge cases: null and empty texts have no ids and decode to no bytes; repeated rows are encoded alike; an empty table gives
an empty result; further columns are ignored; very long texts are blocks of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .pretokens import byte_level_spans, code_points, strings

#: Bytes of text in a block.
BLOCK = 8 << 20
#: Bytes of input for each bucket of words, so that buckets follow the data and a task's share of the words does not grow.
BUCKET_BYTES = 64 << 20
#: Rows whose ids are put together or decoded at once.
ROWS = 500


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file with a base64 token and its id in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens on end, and the offsets of the tokens by id."""
    ranks = read_ranks(path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    return np.frombuffer(b"".join(by_id), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in by_id], dtype=np.int64)))


def gathered(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """flat[offsets[i]:offsets[i + 1]] for every i of ``which``, on end."""
    sizes = (offsets[1:] - offsets[:-1])[which]
    ends = np.cumsum(sizes)
    return flat[np.repeat(offsets[:-1][which] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Block:
    """Rows on their way: the distinct words so far and the word numbers of every text."""

    def __init__(self) -> None:
        self.numbers: dict[int, int] = {}
        self.words: list[str] = []
        self.rows: list[pa.Array] = []
        self.places: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.key = np.uint64(1)
        self.size = 0

    def add(self, part: pa.RecordBatch) -> None:
        joined, codes, offsets = code_points(strings(part.column("text")))
        begins, ends = byte_level_spans(codes, offsets)
        found, first, inverse = np.unique(kernels.span_hashes(codes, begins, ends), return_index=True, return_inverse=True)
        local = np.empty(len(found), np.int32)
        for i, (h, at) in enumerate(zip(found.tolist(), first.tolist(), strict=True)):
            number = self.numbers.setdefault(h, len(self.words))
            if number == len(self.words):
                self.words.append(joined[begins[at] : ends[at]])
            local[i] = number
        self.places.append(local[inverse])
        self.counts.append(np.diff(np.searchsorted(begins, offsets)))
        self.rows.append(part.column("_id"))
        own = kernels.mixed(part.column("_k").to_numpy().view(np.uint64) + np.arange(part.num_rows, dtype=np.uint64))
        self.key = kernels.mixed(self.key.reshape(1) + own.sum(dtype=np.uint64))[0]
        self.size += len(codes)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    """The blocks of a task, each with a key of its rows and its place."""
    done, block = 0, Block()
    place = np.uint64(TaskContext.get().partitionId() << 24)
    for batch in batches:
        for part in kernels.chunks(batch):
            block.add(part)
            if block.size >= BLOCK:
                yield int(kernels.mixed((block.key + place + np.uint64(done)).reshape(1)).view(np.int64)[0]), block
                done, block = done + 1, Block()
    if block.rows:
        yield int(kernels.mixed((block.key + place + np.uint64(done)).reshape(1)).view(np.int64)[0]), block


def packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, byte plane by byte plane, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The n values of ``packed``."""
    planes = pa.decompress(data, 4 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def block_words(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, n, numbers, lengths, size, words): the distinct words of every block, dealt to buckets by their hash.

    The words of a bucket travel as one compressed text with the lengths of the words and their numbers in the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block in blocks(batches):
            where = np.fromiter(block.numbers, np.uint64, len(block.numbers)) % np.uint64(buckets)
            order = np.argsort(where, kind="stable")
            edges = np.searchsorted(where[order], np.arange(buckets + 1))
            rows = []
            for bucket in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[bucket] : edges[bucket + 1]]
                words = [block.words[i].encode() for i in own.tolist()]
                text = b"".join(words)
                gaps = packed(np.diff(own, prepend=0))
                rows.append((bucket, key, len(own), gaps, packed(np.array([len(w) for w in words])), len(text), pa.compress(text, codec="zstd", asbytes=True)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["bucket", "block", "n", "numbers", "lengths", "size", "words"])
            del block  # not beside the next one
        kernels.released()

    return docs.mapInArrow(run, "bucket long, block long, n long, numbers binary, lengths binary, size long, words binary")


def block_places(docs: DataFrame) -> DataFrame:
    """(block, ids, counts, places): the rows of every block, how many pre-tokens each has, and their word numbers, packed."""
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block in blocks(batches):
            rows = pa.concat_arrays(block.rows)
            places = np.concatenate(block.places).astype(np.uint32)
            row = [pa.array([key], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), pa.array([np.concatenate(block.counts)], pa.list_(pa.int64())), pa.array([packed(places)], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, ["block", "ids", "counts", "places"])
            del block, row, places, rows
        kernels.released()

    return docs.mapInArrow(run, f"block long, ids array<{kind}>, counts array<long>, places binary")


def encoded_words(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """(block, n, numbers, sizes, tokens): the ids of the words of every block, each distinct word encoded once.

    A word's bucket goes to one task, which takes its buckets one after the other and keeps the ids of the words of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = _encoder(path, pattern)._encode_single_piece
        known: dict[bytes, np.ndarray] = {}
        bucket = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    known, bucket = {}, row["bucket"]
                text, ends = pa.decompress(row["words"], row["size"], codec="zstd", asbytes=True) if row["size"] else b"", np.cumsum(unpacked(row["lengths"], row["n"]))
                ids, at = [], 0
                for end in ends.tolist():
                    word = text[at:end]
                    found = known.get(word)
                    if found is None:
                        found = known[word] = np.array(piece(word), np.uint32)
                    ids.append(found)
                    at = end
                sizes, tokens = np.array([len(x) for x in ids]), np.concatenate(ids)
                columns = [pa.array([row["block"]], pa.int64()), pa.array([row["n"]], pa.int64()), *[pa.array([x], pa.binary()) for x in (row["numbers"], packed(sizes), packed(tokens))]]
                yield pa.RecordBatch.from_arrays(columns, ["block", "n", "numbers", "sizes", "tokens"])

    return words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "block long, n long, numbers binary, sizes binary, tokens binary")


def input_bytes(docs: DataFrame) -> int:
    """The optimizer's figure of the input's size, which it has from the files; counted where it has none."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def put_together(places: pa.Table, words: pa.Table, path: str, decoded: bool) -> pa.Table:
    """(doc_id, n_tokens, ids) of the rows of one block, with ``decoded`` the bytes too; a batch of the table for every ROWS rows."""
    if places.num_rows != 1:
        raise ValueError("the two passes over the input saw different rows")
    rows, counts = (places.column(c).combine_chunks().flatten() for c in ("ids", "counts"))
    counts = counts.to_numpy()
    which = unpacked(places.column("places")[0].as_py(), int(counts.sum()))
    numbers, sizes, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for i in range(words.num_rows):
        n, gaps, size, token = (words.column(c)[i].as_py() for c in ("n", "numbers", "sizes", "tokens"))
        numbers.append(np.cumsum(unpacked(gaps, n), dtype=np.int64))
        sizes.append(unpacked(size, n).astype(np.int64))
        tokens.append(unpacked(token, int(sizes[-1].sum())))
    numbers, sizes, tokens = np.concatenate(numbers), np.concatenate(sizes), np.concatenate(tokens)
    if len(numbers) != (int(which.max()) + 1 if len(which) else 0):
        raise ValueError("the two passes over the input saw different words")
    order = np.argsort(numbers)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    size_of = sizes[order]
    flat = gathered(tokens, begins, order)
    offsets = np.concatenate(([0], np.cumsum(size_of)))
    edges = np.concatenate(([0], np.cumsum(counts)))
    parts = []
    for first in range(0, len(counts), ROWS):
        out, n_tokens, back = [], [], []
        last = min(first + ROWS, len(counts))
        for begin, end in zip(edges[first:last].tolist(), edges[first + 1 : last + 1].tolist(), strict=True):
            ids = gathered(flat, offsets, which[begin:end])
            n_tokens.append(len(ids))
            out.append(ids.astype("<u4").tobytes())
            if decoded:
                back.append(gathered(*_token_bytes(path), np.frombuffer(out[-1], "<u4")).tobytes())
        columns = {"doc_id": rows[first:last], "n_tokens": pa.array(n_tokens, pa.int64()), "ids": pa.array(out, pa.binary())}
        parts.append(pa.RecordBatch.from_pydict(columns | ({"decoded": pa.array(back, pa.binary())} if decoded else {})))
    return pa.Table.from_batches(parts)


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of every text of docs (doc_id, text), as little-endian unsigned 32-bit integers.

    With ``decoded`` also the bytes that the ids stand for, looked up in the same step: a second one would keep another
    Python worker beside each of these.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_k"), "text")
    schema = f"doc_id {kind}, n_tokens long, ids binary" + (", decoded binary" if decoded else "")

    def together(places: pa.Table, words: pa.Table) -> pa.Table:
        out = put_together(places, words, path, decoded)
        kernels.released()
        return out

    buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // BUCKET_BYTES)
    words = encoded_words(block_words(rows, buckets), path, pattern)
    return block_places(rows).groupBy("block").cogroup(words.groupBy("block")).applyInArrow(together, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (ids as little-endian unsigned 32-bit integers) with the decoded bytes of every row."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, offsets = _token_bytes(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                out = [gathered(flat, offsets, np.frombuffer(x or b"", "<u4")).tobytes() for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the sha256 digests of the ids and of the bytes decoded from them."""
    back = encode(docs, path, pattern, decoded=True)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def vocabulary() -> tuple[str, str]:
    """The public vocabulary's path and pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The digests under the public vocabulary."""
    return digests(docs, *vocabulary())
