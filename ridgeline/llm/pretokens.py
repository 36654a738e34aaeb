"""Pre-tokens of byte-level and word-end BPE as runs of character classes, a few MB of text at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

LETTER, NUMBER, BLANK, OTHER = range(4)
#: Code points that are looked up at once; the surrogates are a piece.
PIECE = 0x800
#: The Unicode property White_Space.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point, looked up a piece at a time: a million characters at once would take a worker 80 MB."""
    table = np.full(0x110000, OTHER, np.uint8)
    for begin in range(0, 0x110000, PIECE):
        if begin == 0xD800:  # surrogates
            continue
        every = "".join(map(chr, range(begin, begin + PIECE)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for found in regex.finditer(pattern, every):
                table[begin + found.start() : begin + found.end()] = kind
    table[list(WHITE_SPACE)] = BLANK
    return table


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts on end, their code points, and the n + 1 offsets of the texts."""
    joined = "".join(texts)
    return joined, np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in texts], dtype=np.int64)))


def _classes(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds, n = class_table()[codes], len(codes)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change = edge[:n].copy()
    change[1:] |= kinds[1:] != kinds[:-1]
    return kinds, edge, change


def _contractions(codes: np.ndarray, kinds: np.ndarray, edge: np.ndarray, change: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the apostrophes ``at`` that begin a token: those that begin 's 't 're 've 'm 'll 'd, and the lengths behind them."""
    n = len(codes)
    at = at[at + 1 < n]
    at = at[(codes[at] == 39) & change[at + 1] & ~edge[at + 1] & (kinds[at + 1] == LETTER)]
    first = codes[at + 1]
    second = np.where((at + 2 < n) & ~edge[np.minimum(at + 2, n)], codes[np.minimum(at + 2, n - 1)], 0)
    one = np.isin(first, [ord(c) for c in "stmd"])
    two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    size = np.where(one, 1, np.where(two, 2, 0))
    return at[size > 0], size[size > 0]


def _cut(starts: np.ndarray, kinds: np.ndarray, edge: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
    """Begin tokens behind contractions, not inside them."""
    starts[at + 1] = False
    behind = at + 1 + size
    behind = behind[behind < len(kinds)]
    starts[behind[(kinds[behind] == LETTER) & ~edge[behind]]] = True


def byte_level_spans(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the pre-tokens of byte-level BPE, which take one space along; they cover every text."""
    kinds, edge, change = _classes(codes, offsets)
    starts = change.copy()
    solid = np.flatnonzero(change & (kinds != BLANK) & ~edge[:-1])
    after_blank = solid[kinds[solid - 1] == BLANK]
    starts[after_blank - 1] = True
    starts[after_blank[codes[after_blank - 1] == 32]] = False
    at, size = _contractions(codes, kinds, edge, change, np.flatnonzero(starts & change & (kinds == OTHER)))
    _cut(starts, kinds, edge, at, size)
    begins = np.flatnonzero(starts)
    return begins, np.append(begins[1:], len(codes)) if len(begins) else begins


def word_end_spans(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the pre-tokens of word-end BPE: runs of letters, single numbers, runs of other characters; no blanks."""
    kinds, edge, change = _classes(codes, offsets)
    starts = change | (kinds == NUMBER)
    at, size = _contractions(codes, kinds, edge, change, np.flatnonzero(change & (kinds == OTHER)))
    _cut(starts, kinds, edge, at, size)
    begins = np.flatnonzero(starts)
    ends = np.append(begins[1:], len(codes)) if len(begins) else begins
    solid = kinds[begins] != BLANK
    return begins[solid], ends[solid]


def strings(column: pa.Array) -> list[str]:
    """The texts of a column; a null is empty."""
    return [x or "" for x in column.to_pylist()]
