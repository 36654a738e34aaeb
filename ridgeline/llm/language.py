"""Operator 3, language identification: script ranges narrow the candidates, Viterbi over word scores labels spans.

Training counts letter trigrams and scripts by language over all training texts. A word's score under a language is the
log-likelihood of its trigrams; languages that don't use the script of the word are ruled out. The best path over the
words of a text, with a penalty for every switch of language, labels spans of mixed texts; the text's language is the one
with most letters.

Edge cases: null texts and texts without a letter are ``und`` with score 0, as is every text if nothing was learned; ties
go to the first language in order; a row without an id is never held out; repeated rows are labelled alike; an empty table
gives an empty result; further columns are ignored; the steps over a text follow its words, without a limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .pretokens import LETTER, class_table, code_points, strings

#: Cells of the trigram table, log cost of a switch, least share of a language's letters that a script must have.
CELLS, SWITCH, SCRIPT_SHARE = 1 << 16, 8.0, 0.01
SMOOTH = 0.5
#: Most languages of a model: its table is held by the driver and every worker, CELLS numbers a language.
MOST_LANGUAGES = 256
#: Bytes of text whose words are labelled together.
GROUP = 12 << 20
# First and last code points of scripts.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)), "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)),
    "armenian": ((0x530, 0x58F),), "hebrew": ((0x590, 0x5FF),), "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)), "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),), "tamil": ((0xB80, 0xBFF),), "telugu": ((0xC00, 0xC7F),), "thai": ((0xE00, 0xE7F),), "georgian": ((0x10A0, 0x10FF),),
    "ethiopic": ((0x1200, 0x137F),), "khmer": ((0x1780, 0x17FF),), "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)), "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x323AF)),
}
OTHER_SCRIPT = len(SCRIPTS)


def script_of(codes: np.ndarray) -> np.ndarray:
    """The number of each code point's script."""
    spans = sorted((begin, end, k) for k, ranges in enumerate(SCRIPTS.values()) for begin, end in ranges)
    begins, ends, kinds = (np.array(x) for x in zip(*spans, strict=True))
    at = np.maximum(np.searchsorted(begins, codes, "right") - 1, 0)
    return np.where((codes >= begins[at]) & (codes <= ends[at]), kinds[at], OTHER_SCRIPT)


def words_and_cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram cells of all letters; the n + 1 offsets of words among letters; those of texts among words; scripts of words."""
    _, codes, offsets = code_points([x.lower() + "\n" for x in texts])
    letters = class_table()[codes] == LETTER
    begins, ends, counts = kernels.runs(letters, offsets)
    clean = np.where(letters, codes, 0).astype(np.uint64)
    at = np.flatnonzero(letters)
    before = np.where(at > 0, clean[at - 1], 0)
    tri = before * np.uint64(0x9E3779B1) + clean[at] * np.uint64(0x85EBCA77C2B2) + clean[np.minimum(at + 1, len(codes) - 1)] * np.uint64(0xC2B2AE3D27D4EB4F)
    cells = (kernels.mixed(tri) >> np.uint64(48)).astype(np.int64)
    return cells, np.concatenate(([0], np.cumsum(ends - begins))), counts, script_of(codes[begins]) if len(begins) else np.zeros(0, np.int64)


def held_out(rows: int, is_: int) -> Column:
    """Whether the checksum of doc_id leaves the remainder ``is_``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % rows == is_, F.lit(False))


class Model:
    """Languages, their log-probabilities of trigram cells, and the scripts that each uses."""

    def __init__(self, langs: list[str], cells: np.ndarray, scripts: np.ndarray) -> None:
        self.langs = langs
        self.log = np.log((cells + SMOOTH) / (cells.sum(1, keepdims=True) + SMOOTH * CELLS)).astype(np.float32).T.copy()
        self.uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)

    def scores(self, cells: np.ndarray, words: np.ndarray, scripts: np.ndarray) -> np.ndarray:
        """A row of scores for every word."""
        if len(words) < 2:
            return np.zeros((0, len(self.langs)), np.float32)
        out = np.add.reduceat(self.log[cells], words[:-1], axis=0)
        use = self.uses[:, scripts].T
        return np.where(use, out, np.where(use.any(1, keepdims=True), np.float32(-1e6), np.float32(0)))


def best_paths(scores: np.ndarray, texts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of every word on the best path of its text. All texts take their first word together, then the second."""
    sizes = np.diff(texts)
    order = np.argsort(-sizes, kind="stable")
    begins, ordered = texts[:-1][order], sizes[order]
    labels = np.zeros(len(scores), np.int16)
    if not len(scores):
        return labels
    active = np.searchsorted(-ordered, -np.arange(ordered[0]) - 1, "right")
    value = scores[begins[: active[0]]].astype(np.float64)
    moved, source = np.zeros((len(scores), scores.shape[1]), bool), np.zeros(len(scores), np.int16)
    for t in range(1, len(active)):
        at = begins[: active[t]] + t
        value_t = value[: active[t]]
        top = value_t.argmax(1)
        best = value_t[np.arange(len(top)), top][:, None] - switch
        moved[at], source[at] = best > value_t, top
        value[: active[t]] = np.maximum(value_t, best) + scores[at]
    now = value.argmax(1).astype(np.int16)
    for t in range(len(active) - 1, -1, -1):
        at = begins[: active[t]] + t
        labels[at] = now[: active[t]]
        if t:
            state = now[: active[t]]
            now[: active[t]] = np.where(moved[at, state], source[at], state)
    return labels


def train(docs: DataFrame) -> Model:
    """The model of docs (text, lang); counts cover all of them, the table's size is fixed for each language.

    More languages than MOST_LANGUAGES are refused, before anything is gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in kernels.chunks(batch):
                cells, words, texts, scripts = words_and_cells(strings(part.column("text")))
                langs = np.array(part.column("lang").to_pylist(), object)
                by_word = np.repeat(np.arange(len(langs)), np.diff(texts))
                by_letter = np.repeat(by_word, np.diff(words))
                for lang in set(langs.tolist()):
                    mine = langs == lang
                    own = held.setdefault(lang, np.zeros(CELLS + OTHER_SCRIPT + 1, np.int64))
                    own[:CELLS] += np.bincount(cells[mine[by_letter]], minlength=CELLS)
                    own[CELLS:] += np.bincount(scripts[mine[by_word]], minlength=OTHER_SCRIPT + 1)
        for lang, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "cell", "n"])

    known = docs.filter("lang is not null and text is not null")
    n_langs = known.select("lang").distinct().count()
    if n_langs > MOST_LANGUAGES:
        raise ValueError(f"{n_langs} languages: a model is bound to MOST_LANGUAGES, {MOST_LANGUAGES}")
    rows = known.select("text", "lang").mapInArrow(run, "lang string, cell int, n long")
    table = rows.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS rows a language
    langs = sorted(table["lang"].unique())
    counts = np.zeros((len(langs), CELLS + OTHER_SCRIPT + 1))
    counts[np.searchsorted(langs, table["lang"]) if len(langs) else [], table["cell"].to_numpy(np.int64)] = table["n"]
    return Model(langs, counts[:, :CELLS], counts[:, CELLS:])


def predicted(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, held-out flag, language and score of every text; with ``spans`` also the labelled runs of words."""
    at = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", spans array<struct<lang:string,begin:long,end:long>>" if spans else ""

    def labelled(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = at.value
        scores, sizes, counts = [], [], []
        for part in parts:
            cells, words, texts, scripts = words_and_cells(strings(part.column("text")))
            scores.append(own.scores(cells, words, scripts))
            sizes.append(np.diff(words))
            counts.append(np.diff(texts))
        score, size, texts = np.concatenate(scores), np.concatenate(sizes), np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        labels = best_paths(score, texts)
        text_of, n = np.repeat(np.arange(len(texts) - 1), np.diff(texts)), len(own.langs)
        letters = np.bincount(text_of * n + labels, weights=size, minlength=(len(texts) - 1) * n).reshape(-1, n)
        top, total = letters.argmax(1), letters.sum(1)
        share = letters[np.arange(len(top)), top] / np.maximum(total, 1)
        columns = [pa.concat_arrays([p.column(c) for p in parts]) for c in ("doc_id", "held_out")]
        columns += [pa.array([own.langs[i] if w else "und" for i, w in zip(top.tolist(), total.tolist(), strict=True)], pa.string()), pa.array(share, pa.float64())]
        if spans:
            cut = np.ones(len(labels) + 1, bool)
            cut[1:-1] = (labels[1:] != labels[:-1]) | (text_of[1:] != text_of[:-1])
            edges = np.flatnonzero(cut)
            found: list[list[dict]] = [[] for _ in range(len(texts) - 1)]
            for b, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                found[text_of[b]].append({"lang": own.langs[labels[b]], "begin": b - int(texts[text_of[b]]), "end": e - int(texts[text_of[b]])})
            columns.append(pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", *["spans"] * spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for part in kernels.chunks(batch):
                parts.append(part)
                size += part.column("text").nbytes
                if size >= GROUP:
                    yield labelled(parts)
                    parts, size = [], 0
        if parts:
            yield labelled(parts)

    def none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            empty = [pa.array([[]] * n, pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])))] if spans else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n)), *empty], ["doc_id", "held_out", "lang_pred", "score", *["spans"] * spans])

    rows = docs.select("doc_id", held_out(4, 2).alias("held_out"), "text")
    return rows.mapInArrow(run if model.langs else none, f"doc_id {kind}, held_out boolean, lang_pred string, score double{more}")


def identified(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, and predict every document's language."""
    return predicted(docs, train(docs.filter(~held_out(4, 2))))
