"""Operator 4, token ids in files of patched frame-of-reference blocks.

Documents are dealt by ranges of doc_id, and of a hash of the text where ids repeat, and sorted; every partition encodes its
texts and writes files of about FILE_IDS ids, so neither a file nor its index grows with the partition. A file holds, in
blocks of ``BLOCK`` ids, the block's least id, the other ids' distances from it packed at a width that a percentile of the
block fits, and the exceptions that don't fit with their places; the begins of all blocks follow, then the documents' ids
and lengths, then a footer. Files are written under a temporary name and renamed, so a repeated task replaces its file by
the same one. They go to the shared folder, on any store that pyarrow opens by its address (file, hdfs, s3, gs, abfs), and are
read back through their indexes, a few blocks at a time; ``ids_between`` seeks to the blocks of any stretch of ids.

Word ids are looked up word by word: each task keeps the ids of words it has met in arrays, by 128 bits of each word and up
to a bound, and encodes the words that are new to a batch together. Texts that hold one of the vocabulary's added tokens are encoded whole by the library.

Edge cases: null and empty texts have the end id alone; repeated rows are written each, in the order of a hash of their texts; a row
without an id comes first; an empty table writes no ids; further columns are ignored; very long texts run over blocks.
"""

from __future__ import annotations

import os
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .byte_bpe import gathered
from .pretokens import code_points, strings, word_end_spans
from .scratch import scratch_path, written

BLOCK = 4096
#: Share of a block's ids that the packed width must fit.
FIT = 0.98
MAGIC = b"PFORIDS1"
#: Ids of a file; the last document of a file may go beyond. Blocks that a reader holds at once.
FILE_IDS, READ_BLOCKS = 1 << 25, 256
END = 1
#: Words whose ids a task keeps.
KEPT_WORDS = 400_000
#: Words that are encoded as one text.
JOINED = 64
#: Makes other code points of a text's, so that their hashes add 64 bits.
OTHER_BITS = 0x2A5A5A5A


def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned values at ``width`` bits each, least bit first."""
    if not width:
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: np.ndarray, width: int, n: int) -> np.ndarray:
    """The inverse of pack."""
    if not width:
        return np.zeros(n, np.uint32)
    bits = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    out = np.zeros(n, np.uint32)
    for k in range(width):
        out |= bits[:, k].astype(np.uint32) << np.uint32(k)
    return out


def encode_block(ids: np.ndarray) -> bytes:
    """Least id, width, number of exceptions, packed distances, places and values of the exceptions."""
    low = int(ids.min())
    gaps = ids.astype(np.uint32) - np.uint32(low)
    fits = int(np.sort(gaps)[min(len(gaps) - 1, int(np.ceil(FIT * len(gaps))) - 1)])
    width = max(fits.bit_length(), 0)
    width = width if width < 32 and (int(gaps.max()).bit_length() - width) * len(gaps) > 48 * int((gaps >> np.uint32(width) > 0).sum()) else int(gaps.max()).bit_length()
    out = np.flatnonzero(gaps >> np.uint32(width) if width < 32 else np.zeros(0)).astype("<u2")
    packed = pack(np.where(np.isin(np.arange(len(gaps)), out), 0, gaps).astype(np.uint32) if len(out) else gaps, width)
    return struct.pack("<IBHH", low, width, len(out), len(ids)) + packed + out.tobytes() + gaps[out].astype("<u4").tobytes()


def decode_block(data: memoryview) -> np.ndarray:
    """The ids of a block."""
    low, width, n_out, n = struct.unpack_from("<IBHH", data)
    at = struct.calcsize("<IBHH")
    size = (n * width + 7) // 8
    gaps = unpack(np.frombuffer(data, np.uint8, size, at), width, n)
    out = np.frombuffer(data, "<u2", n_out, at + size)
    gaps[out] = np.frombuffer(data, "<u4", n_out, at + size + 2 * n_out)
    return gaps + np.uint32(low)


class FileWriter:
    """Writes one file: ids in blocks as they come, then the index."""

    def __init__(self, out) -> None:
        self.out, self.at, self.begins, self.held, self.n_held = out, len(MAGIC), [], [], 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.n_ids = 0
        out.write(MAGIC)

    def add(self, ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> None:
        """Append whole documents, whose ids stand on end in ``ids``."""
        self.doc_ids += doc_ids
        self.lengths += lengths
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK * 64:
            ids = np.concatenate(self.held)
            whole = len(ids) // BLOCK * BLOCK
            self._blocks(ids[:whole])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _blocks(self, ids: np.ndarray) -> None:
        for k in range(0, len(ids), BLOCK):
            block = encode_block(ids[k : k + BLOCK])
            self.begins.append(self.at)
            self.at += len(block)
            self.out.write(block)

    def end(self) -> None:
        """Write what is held, the index and the footer."""
        self._blocks(np.concatenate([np.zeros(0, np.uint32), *self.held]))
        known = np.array([x is not None for x in self.doc_ids], np.uint8)
        index = np.array(self.begins, "<u8").tobytes() + np.array([x or 0 for x in self.doc_ids], "<i8").tobytes() + known.tobytes() + np.array(self.lengths, "<u8").tobytes()
        self.out.write(index + struct.pack("<QQQ", self.at, len(self.begins), len(self.doc_ids)) + MAGIC)


class FileReader:
    """The index of a file, and its ids by seeking to their blocks."""

    def __init__(self, file, size: int) -> None:
        foot = len(MAGIC) + 24
        self.file, tail = file, self._at(file, max(0, size - foot), foot)
        if size < foot + len(MAGIC) or tail[-8:] != MAGIC or self._at(file, 0, 8) != MAGIC:
            raise ValueError("not a token file, or cut short")
        end, n_blocks, n_docs = struct.unpack("<QQQ", tail[:-8])
        index = self._at(file, end, size - foot - end)
        self.edges = np.append(np.frombuffer(index, "<u8", n_blocks), np.uint64(end)).astype(np.int64)
        ids = np.frombuffer(index, "<i8", n_docs, 8 * n_blocks)
        known = np.frombuffer(index, np.uint8, n_docs, 8 * (n_blocks + n_docs))
        self.lengths = np.frombuffer(index, "<u8", n_docs, 8 * (n_blocks + n_docs) + n_docs).astype(np.int64)
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]

    @staticmethod
    def _at(file, begin: int, n: int) -> bytes:
        file.seek(begin)
        return file.read(n)

    def ids_between(self, begin: int, end: int) -> np.ndarray:
        """The ids from place ``begin`` up to ``end`` of the file."""
        if end <= begin:
            return np.zeros(0, np.uint32)
        first, last = begin // BLOCK, (end - 1) // BLOCK + 1
        data = memoryview(self._at(self.file, int(self.edges[first]), int(self.edges[last] - self.edges[first])))
        edges = self.edges[first : last + 1] - self.edges[first]
        return np.concatenate([decode_block(data[b:e]) for b, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)])[begin - first * BLOCK : end - first * BLOCK]

    def documents(self, blocks: int = READ_BLOCKS) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
        """(doc_ids, lengths, ids on end) of the documents, as many at once as so many blocks hold, one at least."""
        stops = np.cumsum(self.lengths)
        at, done = 0, 0
        while at < len(stops):
            to = max(at + 1, int(np.searchsorted(stops, done + blocks * BLOCK, "right")))
            yield self.doc_ids[at:to], self.lengths[at:to], self.ids_between(done, int(stops[to - 1]))
            at, done = to, int(stops[to - 1])


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _added(path: str) -> tuple[str, ...]:
    """The added tokens, as they are and normalised: the library finds them before it cuts a text into words."""
    held = [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]
    return tuple({x for t in held for x in (t, normalized(t)) if x})


@lru_cache(maxsize=2)
def _endings(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Of every id: whether its token ends a word, and how many bytes of the word it stands for."""
    held = _tokenizer(path).get_vocab()
    ends, sizes = np.zeros(max(held.values()) + 1, bool), np.zeros(max(held.values()) + 1, np.int64)
    for token, i in held.items():
        ends[i], sizes[i] = token.endswith("</w>"), len(token.removesuffix("</w>"))
    return ends, sizes


def encoded_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words on end, and how many each has.

    JOINED words go to the library as one text with blanks between, which is faster; where its words don't end just where
    these do, in bytes, each goes alone.
    """
    ends, sizes = _endings(path)
    parts = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
    flat, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for k in range(0, len(parts), 64):
        for part, e in zip(parts[k : k + 64], _tokenizer(path).encode_batch_fast([" ".join(x) for x in parts[k : k + 64]], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            stops = np.flatnonzero(ends[ids]) + 1
            n = np.diff(stops, prepend=0)
            if len(stops) != len(part) or stops[-1] != len(ids) or not np.array_equal(np.cumsum(sizes[ids])[stops - 1], np.cumsum([len(w.encode()) for w in part])):
                each = [x.ids for x in _tokenizer(path).encode_batch_fast(part, add_special_tokens=False)]
                ids, n = np.fromiter(chain.from_iterable(each), np.uint32), np.array([len(x) for x in each])
            flat.append(ids)
            counts.append(n)
    return np.concatenate(flat), np.concatenate(counts)


class KeptWords:
    """The ids of words that a task has met, by 128 bits of each word; slot 0 is the end of a text."""

    def __init__(self) -> None:
        self.slots: dict[int, int] = {}
        self.second, self.edges, self.flat = np.zeros(1, np.uint64), np.array([0, 1]), np.array([END], np.uint32)

    def forget(self) -> None:
        """Forget the older half."""
        cut = (len(self.second) + 1) // 2
        self.slots = {h: s - cut for h, s in self.slots.items() if s > cut}
        self.second = np.concatenate((self.second[:1], self.second[cut + 1 :]))
        begin = self.edges[min(cut + 1, len(self.edges) - 1)]
        self.flat = np.concatenate((self.flat[:1], self.flat[begin:]))
        self.edges = np.concatenate(([0, 1], self.edges[cut + 2 :] - begin + 1))

    def of(self, joined: str, begins: np.ndarray, ends: np.ndarray, first: np.ndarray, second: np.ndarray, path: str) -> np.ndarray:
        """The slots of distinct words, joined[begin:end] with the hashes ``first`` and ``second``; new ones are encoded together."""
        keys = first.tolist()
        while True:
            at = np.fromiter(map(self.slots.get, keys, repeat(0)), np.int64, len(keys))
            new = np.flatnonzero((at == 0) | (self.second[at] != second))
            if not self.slots or len(self.second) + len(new) <= KEPT_WORDS:
                break
            self.forget()
        if len(new):
            flat, counts = encoded_words([joined[b:e] for b, e in zip(begins[new].tolist(), ends[new].tolist(), strict=True)], path)
            at[new] = np.arange(len(self.second), len(self.second) + len(new))
            self.slots.update(zip(first[new].tolist(), at[new].tolist(), strict=True))
            self.second = np.concatenate((self.second, second[new]))
            self.edges = np.concatenate((self.edges, self.edges[-1] + np.cumsum(counts)))
            self.flat = np.concatenate((self.flat, flat))
        return at


_KNOWN: dict[str, KeptWords] = {}


def normalized(text: str) -> str:
    """NFC and lower case, character by character."""
    text = text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def text_ids(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts on end, each text closed by END, and the lengths."""
    plain = [normalized(x) for x in texts]
    marked = [i for i, (x, y) in enumerate(zip(texts, plain, strict=True)) if any(t in x or t in y for t in _added(path))]
    if marked:
        at = set(marked)
        ids, sizes = text_ids(["" if i in at else x for i, x in enumerate(texts)], path)
        pieces = np.split(ids, np.cumsum(sizes)[:-1])
        for i in marked:
            pieces[i] = np.array([*_tokenizer(path).encode(texts[i], add_special_tokens=False).ids, END], np.uint32)
        return np.concatenate(pieces), np.array([len(x) for x in pieces])
    joined, codes, offsets = code_points(plain)
    begins, ends = word_end_spans(codes, offsets)
    found, first, inverse = np.unique(kernels.span_hashes(codes, begins, ends), return_index=True, return_inverse=True)
    known, begin, end = _KNOWN.setdefault(path, KeptWords()), begins[first], ends[first]
    slots = known.of(joined, begin, end, found, kernels.span_hashes(codes ^ np.uint32(OTHER_BITS), begin, end), path)
    behind = np.searchsorted(begins, offsets[1:])
    which = np.insert(slots[inverse], behind, 0)  # the end id is one more word, put behind the words of every text
    sizes = np.diff(known.edges)[which]
    sums = np.concatenate(([0], np.cumsum(sizes)))
    stops = behind + np.arange(1, len(texts) + 1)
    return gathered(known.flat, known.edges, which), np.diff(np.concatenate(([0], sums[stops])))


def write_files(docs: DataFrame, path: str, folder: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Write docs (doc_id, text) to token files in ``folder`` in ascending order of doc_id; (name, part, seq, docs, ids), a row a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        out, writer, made = None, None, []

        def closed() -> None:
            writer.end()
            out.close()
            store.move(f"{place}/_{made[-1]}.{attempt}.tmp", f"{place}/{made[-1]}")

        for batch in batches:
            for own in kernels.chunks(batch, limit=min(kernels.CHUNK, 4 * file_ids)):
                if writer is None:
                    made.append(f"part-{part:06d}-{len(made):05d}.pfor")
                    out = store.open_output_stream(f"{place}/_{made[-1]}.{attempt}.tmp")
                    writer = FileWriter(out)
                ids, sizes = text_ids(strings(own.column("text")), path)
                writer.add(ids, own.column("doc_id").to_pylist(), sizes.tolist())
                if writer.n_ids >= file_ids:
                    closed()
                    yield _made(made[-1], part, len(made) - 1, writer)
                    writer = None
        if writer is not None:
            closed()
            yield _made(made[-1], part, len(made) - 1, writer)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "_text"]
    ordered = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_text"), "text").repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    return written(ordered.select("doc_id", "text").mapInArrow(run, "name string, part long, seq long, docs long, ids long"), "token-files")


def _made(name: str, part: int, seq: int, writer: FileWriter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"name": name, "part": part, "seq": seq, "docs": len(writer.doc_ids), "ids": writer.n_ids}])


def read_files(folder: str, files: DataFrame, blocks: int = READ_BLOCKS) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the token ``files`` of ``folder``; ids as little-endian unsigned 32-bit integers."""
    before = Window.partitionBy(F.lit(0)).orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    placed = files.select("name", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                at = row["before"]
                with store.open_input_file(f"{place}/{row['name']}") as file:
                    for doc_ids, lengths, ids in FileReader(file, file.size()).documents(blocks):
                        stops = np.cumsum(lengths)
                        data, edges = ids.astype("<u4").tobytes(), np.append(0, stops * 4).tolist()
                        yield pa.RecordBatch.from_arrays([
                            pa.array(doc_ids, pa.int64()), pa.array(at + stops - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                            pa.array([data[b:e] for b, e in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                        ], ["doc_id", "start", "n_tokens", "ids"])
                        at += len(ids)

    return placed.repartition(n, "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def vocabulary() -> str:
    """The public vocabulary's path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from files written to the shared folder and read back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    files = write_files(docs, vocabulary(), folder)
    return read_files(folder, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
