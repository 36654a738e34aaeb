"""Operator 6, toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

Words that look disguised (figures or signs among letters, doubled letters, single letters set apart) become lattices:
each character may stand for itself, for the letters it imitates (as a sign, with a mark on it, or in another script), or
for nothing where it repeats or separates; a star between letters may stand for any letter that the model knows behind the
one before, in runs of any length.
Viterbi decoding under a character trigram model picks the likeliest reading. A masked stretch that a known feature word
fits, letter for letter and star for letter, is read as that word: stars are put where such words stand. A text is then
scored by the words and word beginnings that its plain and restored words share with the training texts: each known one has
a precision, and the score is the chance that at least one of them tells the truth.

The character model counts the texts of all documents in a table of fixed size: 64 symbols (the letters of ASCII and Latin-1,
a blank, and six for all other letters by their code points), so 262,144 trigrams of 8 bytes. The features alone are learned from a sample of at most about
TRAIN_ROWS labelled rows, picked by a hash of doc_id. How far a feature's counts must be beyond chance is chosen by
cross-validation over FOLDS parts of that sample, so it fits small and large samples; rows that are held out are not looked at.
When texts are scored, only stretches in which a feature can be read at all are decoded: a reading without one adds nothing.

Edge cases: null and empty texts get the base rate; rows without an id are never held out and have no label; repeated
labels count once; without labels of either kind every score is the base rate; empty tables give empty results; further
columns are ignored; equal texts with different labels count as toxic; a text of any length and every disguised stretch in
it are read whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .language import held_out
from .pretokens import BLANK, LETTER, NUMBER, class_table, code_points, strings
from .scratch import dropped, written

#: Bound of the training sample.
TRAIN_ROWS = 20_000
#: Lengths of the word beginnings that count as features; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6)
LEAST_TEXTS, LEAST_PRECISION = 3, 0.9
#: A feature's counts must be as unlikely by chance as one of these (minus the logarithm of the likelihood ratio to the base rate).
SURPRISES = (4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 12.0, 14.0, 18.0)
FOLDS = 4
#: Letters that the character model tells apart, after the blank; others share the symbols that are left.
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, (*range(0xDF, 0xF7), *range(0xF8, 0x100))))
SYMBOLS = 64
#: Readings of stretches up to this length are remembered.
KEPT_LENGTH = 256
# The letters that figures and signs imitate.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "{": "c",
}
# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t",
}
SEPARATORS = " .-_*·~"
#: Letters that one sign imitates alike.
_SAME = {"l": "i"}
SIGNS = "0123456789@$!|+€£({"
_SINGLE_SIGNS = "@$!|+"


@lru_cache(maxsize=1)
def bare_letters() -> np.ndarray:
    """For every code point the Latin letter that a marked or foreign letter looks like, or 0."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x80, 0x2C00):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if "a" <= base <= "z":
            table[code] = ord(base)
    for c, base in LOOKALIKES.items():
        table[ord(c)] = ord(base)
    return table


@lru_cache(maxsize=1)
def _bare() -> dict[str, str]:
    table = bare_letters()
    return {chr(code): chr(table[code]) for code in np.flatnonzero(table)}


def bare(c: str) -> str:
    """The Latin letter that ``c`` looks like; empty if it is one, or looks like none."""
    return _bare().get(c, "") if c > "\x7f" else ""


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """The symbol of every code point: 0 the blank, then the letters of ALPHABET, then those that other characters share."""
    table = (1 + len(ALPHABET) + np.arange(0x110000) % (SYMBOLS - 1 - len(ALPHABET))).astype(np.uint8)
    table[32] = 0
    table[[ord(c) for c in ALPHABET]] = 1 + np.arange(len(ALPHABET))
    return table


def _among(codes: np.ndarray, chars: str) -> np.ndarray:
    """Which code points are among ``chars``."""
    table = np.zeros(0x2100, bool)
    table[[ord(c) for c in chars]] = True
    return table[np.minimum(codes, 0x20FF)]


def disguised(texts: list[str]) -> list[list[str]]:
    """The stretches of lower-case texts that look disguised, each up to the blanks around it, found by arrays over all texts.

    Signs or figures between letters, at the start of a word before a letter or behind its last letter; doubled letters;
    stars between letters; letters that look like a Latin one; three or more single letters or signs with nothing but
    separators between them.
    """
    joined, codes, offsets = code_points([x + "\n" for x in texts])
    letter, sign, figure = class_table()[codes] == LETTER, _among(codes, SIGNS), _among(codes, SIGNS[:10])
    blank = class_table()[codes] == BLANK
    after = lambda x, k=1: np.concatenate((x[k:], np.zeros(k, x.dtype)))
    before = lambda x, fill=False: np.concatenate(([fill], x[:-1]))
    word = letter | (class_table()[codes] == NUMBER)
    at = [
        np.flatnonzero(sign & before(blank, True) & after(letter) & ~_among(codes, "({")),
        np.flatnonzero(letter & after(figure) & ~after(word | _among(codes, "_"), 2)),
        np.flatnonzero(letter & (codes == after(codes))),
        np.flatnonzero(letter & (codes > 0x7F) & (bare_letters()[codes] > 0)),
    ]
    for inside in (sign, _among(codes, "*")):
        begins, ends, _ = kernels.runs(inside, offsets)
        fits = begins > 0
        fits[fits] &= letter[begins[fits] - 1] & letter[np.minimum(ends[fits], len(codes) - 1)]
        at.append(begins[fits])
    starts, stops, _ = kernels.runs(~blank, offsets)
    first = last = np.unique(np.searchsorted(starts, np.concatenate(at), "right") - 1)
    single = np.flatnonzero((word | _among(codes, _SINGLE_SIGNS)) & ~before(word) & ~after(word))
    if len(single) > 2:
        others = np.cumsum(~_among(codes, SEPARATORS))
        near = (others[single[1:] - 1] == others[single[:-1]]) & (np.diff(single) > 1)
        begins, ends, _ = kernels.runs(near, np.array([0, len(near)]))
        long = ends - begins >= 2
        token = lambda x: np.searchsorted(starts, x, "right") - 1
        first, last = np.concatenate((first, token(single[begins[long]]))), np.concatenate((last, token(single[ends[long]])))
    order = np.lexsort((-last, first))
    out: list[list[str]] = [[] for _ in texts]
    done = -1
    for b, e, t in zip(first[order].tolist(), last[order].tolist(), (np.searchsorted(offsets, starts[first[order]], "right") - 1).tolist(), strict=True):
        if e > done:
            out[t].append(joined[starts[max(b, done + 1)] : stops[e]].strip(".,;:?\"'#%&*)"))
            done = e
    return out


class Letters:
    """A character trigram model over SYMBOLS symbols, smoothed by bigrams; from counts by trigram, as a table or by spelling."""

    def __init__(self, counts: np.ndarray | dict[str, int]) -> None:
        if isinstance(counts, dict):
            cells = np.zeros(SYMBOLS**3, np.int64)
            np.add.at(cells, [self.cell(gram) for gram in counts], list(counts.values()))
            counts = cells
        self.tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        pair, two = self.tri.sum(0), self.tri.sum(2)
        low = (pair + 0.05) / (pair.sum(1) + 2.0)[:, None]
        self.costs = -np.log((self.tri + 4 * low) / (two + 4)[:, :, None])
        letters = np.arange(1, 1 + len(ALPHABET))
        self.behind = [[ALPHABET[k - 1] for k in letters if pair[b, k] > 0] for b in range(SYMBOLS)]
        # what a star costs as each letter of the alphabet, out of reach where the letter before has never led to it
        self.star = np.where(pair[None, :, letters] > 0, self.costs[:, :, letters] + 0.4, np.inf)
        # Every pair of symbols that stars lead to at all, they lead to by SYMBOLS + 1 letters; a letter costs 0.2 more than a star
        # let go at least. So a reading through more letters than this is never the likeliest.
        reach = self.star[np.isfinite(self.star)].max(initial=0.0)
        self.most_stars = 4 + math.ceil((SYMBOLS + 1) * reach / 0.2)

    @staticmethod
    def cell(gram: str) -> int:
        a, b, c = (int(symbol_table()[ord(x)]) for x in gram)
        return (a * SYMBOLS + b) * SYMBOLS + c

    def count(self, gram: str) -> int:
        """How often the three symbols of ``gram`` were counted."""
        return int(self.tri.reshape(-1)[self.cell(gram)])

    def cost(self, two: str, c: str) -> float:
        """Minus the log-probability of c after two characters."""
        table = symbol_table()
        return float(self.costs[table[ord(two[0])], table[ord(two[1])], table[ord(c)]])


_MASK = re.compile(r"(?<=[^\W\d_])\*+(?=[^\W\d_])")


def readings_of(token: str) -> list[tuple[list[tuple[str, float]], bool]]:
    """The lattice of a stretch: for every character what it may stand for at which cost, and whether it is a star for any letter."""
    spaced = sum(c in SEPARATORS for c in token) * 2 >= len(token) - 2
    runs = [len(r) for found in re.finditer(r"(?s)(.)\1*", token) for r in [found.group()] for _ in r]
    masks = {at for found in _MASK.finditer(token) for at in range(*found.span())}
    out, before = [], ""
    for at, ch in enumerate(token):
        if ch in SEPARATORS:
            options = [("", 0.0), (" ", 1.0 if ch == before else 4.0)] if spaced else [("", 2.0), (" ", 0.5)]
            options = [("", 0.2)] if at in masks and ch == before else [("", 2.0)] if at in masks else options
        elif ch.isalpha():
            options = [(ch, 0.0)] + ([(bare(ch), 1.0)] if bare(ch) else []) + ([("", 0.2 if runs[at] > 2 else 5.0)] if ch == before else [])
        else:
            options = [(c, 0.4) for c in IMITATES.get(ch, "")] + [("", 9.0), (" ", 6.0)] + ([("", 0.2)] if ch == before else [])
        out.append((options, at in masks))
        before = ch
    return out


def restored(token: str, model: Letters) -> str:
    """The likeliest reading of a disguised stretch; words in it are parted by a blank."""
    if "*" in token and _MASK.search(token):
        return _unmasked(token, model)
    paths: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}  # the reading as links, last character first
    for options, _ in readings_of(token):
        best: dict[str, tuple[float, tuple | None]] = {}
        for two, (cost, out) in paths.items():
            for c, extra in options:
                state = two if not c or (c == " " and two[1] == " ") else two[1] + c
                price = cost + extra + (model.cost(two, c) if state is not two else 0.0)
                if state not in best or price < best[state][0]:
                    best[state] = (price, out if state is two else (out, c))
        paths = best
    link = min(((cost + (model.cost(two, " ") if two[1] != " " else 0), out) for two, (cost, out) in paths.items()), key=lambda x: x[0])[1]
    letters = []
    while link:
        link, c = link
        letters.append(c)
    return "".join(reversed(letters)).strip()


def _unmasked(token: str, model: Letters) -> str:
    """``restored`` for stretches with masking stars: all pairs of last symbols at once, as there are letters for every star.

    Stars of a run beyond ``most_stars`` are let go at once, as every likeliest reading lets as many go.
    """
    costs, table = np.full((SYMBOLS, SYMBOLS), np.inf), symbol_table()
    costs[0, 0] = 0.0
    trail: list[tuple[np.ndarray, np.ndarray, list[str]]] = []
    stars = 0
    for options, masks in readings_of(token):
        stars = stars + 1 if masks else 0
        if stars > model.most_stars:
            continue
        best, back, move = np.full_like(costs, np.inf), np.zeros(costs.shape, np.uint8), np.full(costs.shape, -1, np.int16)
        chars: list[str] = []
        stay = min((extra for c, extra in options if not c), default=np.inf)
        blank = min((extra for c, extra in options if c == " "), default=np.inf)
        best[:] = costs + stay
        best[:, 0] = costs[:, 0] + min(stay, blank)  # a blank behind a blank is none

        def reach(symbols, prices: np.ndarray, char: str | None) -> None:
            """Steps to ``symbols``: prices by the last two symbols and the next one."""
            total = costs[:, :, None] + prices
            least, first = total.min(0), total.argmin(0)
            better = least < best[:, symbols]
            best[:, symbols] = np.where(better, least, best[:, symbols])
            back[:, symbols] = np.where(better, first, back[:, symbols])
            number = len(chars) + np.arange(len(symbols))
            move[:, symbols] = np.where(better, number[None, :], move[:, symbols])
            chars.extend([char] if char else ALPHABET)

        for c, extra in options:
            if c and not c.isspace():
                k = np.array([table[ord(c)]])
                reach(k, model.costs[:, :, k] + extra, c)
            elif c:
                prices = model.costs[:, :, :1] + extra
                prices[:, 0] = np.inf
                reach(np.array([0]), prices, " ")
        if masks:
            reach(np.arange(1, 1 + len(ALPHABET)), model.star, None)
        trail.append((back, move, chars))
        costs = best
    ends = costs.copy()
    ends[:, 1:] += model.costs[:, 1:, 0]
    a, b = np.unravel_index(ends.argmin(), ends.shape)
    letters = []
    for back, move, chars in reversed(trail):
        if move[a, b] >= 0:
            letters.append(chars[move[a, b]])
            a, b = back[a, b], a
    return "".join(reversed(letters)).strip()


@lru_cache(maxsize=1)
def _plain() -> dict[int, str | None]:
    """For str.translate: letters as the bare ones, those that one sign imitates made equal; separators away."""
    letters = {ord(c): base for c, base in _bare().items()}
    return {**letters, **{ord(c): same for c, same in _SAME.items()}, **{c: _SAME[base] for c, base in letters.items() if base in _SAME}, **{ord(c): None for c in SEPARATORS if c != "*"}}


_REPEATS, _NO_LETTER = re.compile(r"(?s)(.)\1+"), re.compile(r"[\W\d_]")


def skeletons(text: str) -> list[str] | None:
    """What every reading of a stretch shares: bare letters without repeats, with those that one sign imitates made equal.

    A sign counts for its letters or for nothing, each way; None where that would be too many ways, or stars mask letters.
    """
    if "*" in text:
        return None
    plain = text.translate(_plain())
    if not _NO_LETTER.search(plain):
        return [_REPEATS.sub(r"\1", plain)]
    out = [""]
    for ch in plain:
        if len(out) > 8:
            return None
        read = ch if ch.isalpha() else IMITATES.get(ch, "")[:1]
        ways = [_SAME.get(read, read)] if read else [""]
        out = [x if w == x[-1:] else x + w for x in out for w in (ways if ch.isalpha() else [*ways, ""])]
    return out


class Gate:
    """Whether a stretch can hold one of the features, whatever its reading."""

    def __init__(self, features: list[str]) -> None:
        self.found = ahocorasick.Automaton()
        for word in features:
            for skeleton in skeletons(word) or [""]:
                self.found.add_word(skeleton, skeleton)
        if features:
            self.found.make_automaton()

    def passes(self, token: str) -> bool:
        if not len(self.found):
            return False
        forms = skeletons(token)
        return forms is None or any(next(self.found.iter(x), None) is not None for x in forms)


def fitting(token: str, words: list[str]) -> str | None:
    """The word that a masked stretch spells with a letter for each star, or with fewest stars let go; two letters and a third of the word are seen."""
    parts, seen = [], 0
    for piece in re.finditer(r"(?s)(.)\1*", token):
        ch, n = piece[1], len(piece[0])
        if ch == "*":
            parts.append(f"([^\\W\\d_]{{1,{n}}})")
        elif ch.isalpha():
            seen += 1
            parts.append(f"[{ch}{bare(ch)}]{{1,{n}}}")
        elif ch in IMITATES:
            parts.append(f"[{IMITATES[ch]}]{{1,{n}}}")
        elif ch not in SEPARATORS:
            return None
    pattern = re.compile("".join(parts))
    found = [(-sum(map(len, m.groups())), w) for w in words if seen >= 2 and 3 * seen >= len(w) and (m := pattern.fullmatch(w))]
    return min(found)[1] if found else None


class Restorer:
    """Readings of disguised stretches, the latest ones remembered; with a gate, of those alone that pass it."""

    def __init__(self, model: Letters, gate: Gate | None = None, kept: int = 50_000, words: list[str] | None = None) -> None:
        self.model, self.gate, self.kept, self.known, self.lexicon = model, gate, kept, OrderedDict(), words or []

    def reading(self, token: str) -> str:
        """What a stretch is read as; itself if it can hold no feature."""
        read = self.known.get(token)
        if read is None:
            wanted = sum(map(str.isalpha, token)) >= 2 and (self.gate is None or self.gate.passes(token))
            read = ""
            if wanted:
                read = self._spelled(token) or restored(token, self.model)
            if len(token) <= KEPT_LENGTH:
                if len(self.known) >= self.kept:
                    self.known.popitem(last=False)
                self.known[token] = read
        return read

    def _spelled(self, token: str) -> str:
        """A stretch with its masked pieces as the known words that fit them; empty without one."""
        if not self.lexicon or not _MASK.search(token):
            return ""
        pieces = [(fitting(x, self.lexicon) if _MASK.search(x) else None, x) for x in token.split()]
        return " ".join(w or x for w, x in pieces) if any(w for w, _ in pieces) else ""

    def of(self, texts: list[str]) -> list[str]:
        """The readings of all disguised stretches of each text that differ from what is written, as one string a text."""
        return [" ".join(filter(None, (r for token in found for r in [self.reading(token)] if r != token))) for found in disguised(texts)]

    def words(self, text: str) -> str:
        """The readings of one text."""
        return self.of([text])[0]


def feature_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, begin, end) of every word and word beginning; a text is lower case."""
    _, codes, offsets = code_points([x + "\n" for x in texts])
    begins, ends, counts = kernels.runs(class_table()[codes] == LETTER, offsets)
    text_of = np.repeat(np.arange(len(texts)), np.diff(counts))
    out = []
    for size in BEGINNINGS:
        long = ends - begins > size
        stop = begins[long] + size if size else ends[long]
        out.append((kernels.mixed(kernels.span_hashes(codes, begins[long], stop) + np.uint64(size)), text_of[long], begins[long], stop))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def gram_counts(texts: list[str]) -> np.ndarray:
    """The counts of all trigrams of symbols in the words of lower-case texts; a word counts once for each text."""
    _, codes, offsets = code_points([x + "\n" for x in texts])
    begins, ends, counts = kernels.runs(class_table()[codes] == LETTER, offsets)
    hashes, text_of = kernels.span_hashes(codes, begins, ends), np.repeat(np.arange(len(texts)), np.diff(counts))
    _, once = np.unique(kernels.mixed(hashes + kernels.mixed(text_of.astype(np.uint64))), return_index=True)
    begins, sizes, symbols = begins[once], (ends - begins)[once], symbol_table()[codes]
    place = np.arange((sizes + 1).sum()) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    begin, size = np.repeat(begins, sizes + 1), np.repeat(sizes, sizes + 1)
    key = np.zeros(len(place), np.int64)
    for back in (2, 1, 0):
        at = place - back
        key = key * SYMBOLS + np.where((at >= 0) & (at < size), symbols[np.clip(begin + at, 0, max(len(codes) - 1, 0))] if len(codes) else 0, 0)
    return np.bincount(key, minlength=SYMBOLS**3)


class Model:
    """Sorted feature hashes with their precisions, the features themselves, the base rate and the character model."""

    def __init__(self, hashes: np.ndarray, precision: np.ndarray, base: float, letters: Letters, words: list[str] | None = None) -> None:
        order = np.argsort(hashes)
        self.hashes, self.precision, self.base, self.letters, self.words = hashes[order], precision[order], base, letters, words or []
        # the features that are words themselves, not beginnings of words
        own = {w: feature_hashes([w])[0][0] for w in self.words}
        self.whole = [w for w in self.words if own[w] in set(hashes.tolist())]

    def scores(self, texts: list[str]) -> np.ndarray:
        """The score of every lower-case text with its restored words; each word counts once for each text."""
        return self.of(texts, *feature_hashes(texts)[:3])

    def of(self, texts: list[str], hashes: np.ndarray, text: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The scores from the features of the texts."""
        miss = np.full(len(texts), np.log1p(-self.base))
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == hashes)
            found: dict[tuple[int, int], float] = {}
            for t, b, f in zip(text[hit].tolist(), begin[hit].tolist(), at[hit].tolist(), strict=True):
                found[t, b] = max(found.get((t, b), 0.0), float(self.precision[f]))
            for (t, _), p in found.items():
                miss[t] += np.log1p(-p)
        return 1 - np.exp(miss)


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled rows to learn from, about TRAIN_ROWS at most."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out(5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > TRAIN_ROWS:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * TRAIN_ROWS / n))
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(known), "doc_id")  # bounded by TRAIN_ROWS
    return rows.groupBy("text").agg(F.max("toxic").alias("toxic"))


def letter_model(docs: DataFrame) -> Letters:
    """The character model, counted over the words of all documents, each once a text."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for part in kernels.chunks(batch):
                total += gram_counts([x.lower() for x in strings(part.column("text"))])
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["gram", "n"])

    # no more rows than the table has cells
    table = docs.select("text").mapInArrow(grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**3, np.int64)
    counts[table["gram"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    return Letters(counts)


def feature_counts(restored_rows: DataFrame) -> DataFrame:
    """(feature, word, bad0, every0, ..): in how many toxic texts and in how many texts of each fold a feature is; restored_rows: (text, toxic, fold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.chunks(batch):
                texts = strings(part.column("text"))
                joined = "".join(x + "\n" for x in texts)
                toxic, fold = (part.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("toxic", "fold"))
                hashes, text, begin, end = feature_hashes(texts)
                _, once = np.unique(np.stack((hashes, text.astype(np.uint64)), 1), axis=0, return_index=True)
                hashes, text, begin, end = hashes[once], text[once], begin[once], end[once]
                kinds, first, where = np.unique(hashes, return_index=True, return_inverse=True)
                counts = [np.bincount(where, weights=(fold[text] == f) * w, minlength=len(kinds)).astype(np.int64) for f in range(FOLDS) for w in (toxic[text], 1)]
                words = [joined[b:e] for b, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(words, pa.string()), *map(pa.array, counts)], ["feature", "word", *names])

    names = [f"{c}{f}" for f in range(FOLDS) for c in ("bad", "every")]
    counted = restored_rows.mapInArrow(run, "feature long, word string, " + ", ".join(f"{c} long" for c in names))
    return counted.groupBy("feature").agg(F.min("word").alias("word"), *[F.sum(c).alias(c) for c in names])


def surprise_of(bad: np.ndarray, every: np.ndarray, base: float) -> np.ndarray:
    """Minus the logarithm of the likelihood ratio to the base rate."""
    share = bad / np.maximum(every, 1)
    rest = np.where(share < 1, (every - bad) * np.log(np.maximum(1 - share, 1e-9) / (1 - base)), 0.0)
    return bad * np.log(np.maximum(share, 1e-9) / base) + rest


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn the trigrams from all documents and the features from the sample."""
    letters = letter_model(docs)
    held = docs.sparkSession.sparkContext.broadcast(letters)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Restorer(held.value)
        for batch in batches:
            for part in kernels.chunks(batch):
                texts = [x.lower() for x in strings(part.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array([x + "\n" + y for x, y in zip(texts, own.of(texts), strict=True)], pa.string()), part.column("toxic"), part.column("fold")], ["text", "toxic", "fold"])

    rows = sample(docs, labels).select("text", F.col("toxic").cast("int"), F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))
    rows = written(rows.mapInArrow(restore, "text string, toxic int, fold int"), "toxic-sample")
    totals = {r["fold"]: (r["n"], r["bad"]) for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")).collect()}
    total = sum(F.col(f"bad{f}") for f in range(FOLDS)), sum(F.col(f"every{f}") for f in range(FOLDS))
    likely = feature_counts(rows).filter((total[0] >= LEAST_TEXTS) & (2 * total[0] >= total[1])).toPandas()  # words of the sample
    bad, every = (likely[[f"{c}{f}" for f in range(FOLDS)]].to_numpy(np.int64) for c in ("bad", "every"))
    hashes = likely["feature"].to_numpy(np.int64).view(np.uint64)

    def learned(without: int | None, least: float) -> Model:
        parts = [f for f in range(FOLDS) if f != without]
        n, toxic = (sum(totals.get(f, (0, 0))[i] for f in parts) for i in (0, 1))
        base, b, e = (toxic + 0.5) / (n + 1.0), bad[:, parts].sum(1), every[:, parts].sum(1)
        chosen = np.flatnonzero((b >= LEAST_TEXTS) & (b >= LEAST_PRECISION * e) & (surprise_of(b, e, base) >= least))
        words = likely["word"].to_numpy()[chosen].tolist() if without is None else None
        return Model(hashes[chosen], (b[chosen] + 0.2) / (e[chosen] + 1.0), min(0.4, 0.1 * base), letters if without is None else None, words)

    tried = docs.sparkSession.sparkContext.broadcast([[learned(f, x) for x in SURPRISES] for f in range(FOLDS)])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.chunks(batch):
                toxic, fold = (part.column(x).to_numpy(zero_copy_only=False) for x in ("toxic", "fold"))
                for f in np.unique(fold).tolist():
                    texts = strings(part.column("text").filter(pa.array(fold == f)))
                    found = feature_hashes(texts)[:3]
                    called = np.array([m.of(texts, *found) >= 0.5 for m in tried.value[f]])
                    right = (called & (toxic[fold == f] == 1)).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(range(len(SURPRISES)), pa.int64()), pa.array(right), pa.array(called.sum(1) - right)], ["at", "right", "wrong"])

    outcome = rows.mapInArrow(judged, "at long, right long, wrong long").groupBy("at").agg(F.sum("right").alias("right"), F.sum("wrong").alias("wrong")).collect()
    toxic = sum(x[1] for x in totals.values())
    quality = {r["at"]: 2 * r["right"] / max(1, r["right"] + r["wrong"] + toxic) for r in outcome}
    enough = max(quality.values(), default=0.0) - 1 / max(1, toxic)  # as good as the best, but for one text
    best = next(i for i in range(len(SURPRISES)) if quality.get(i, 0.0) >= enough)
    held.destroy()
    tried.destroy()
    dropped(rows)
    return learned(None, SURPRISES[best])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text)."""
    at = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(at.value.letters, Gate(at.value.words), words=at.value.whole)
        for batch in batches:
            for part in kernels.chunks(batch):
                texts = [x.lower() for x in strings(part.column("text"))]
                score = at.value.scores([x + "\n" + y for x, y in zip(texts, restore.of(texts), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(5, 0).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled rows that are not held out, and score every document."""
    return scored(docs, train(docs, labels))
