"""Readings of disguised stretches against all readings of short ones, and the gate against no gate."""

from __future__ import annotations

import itertools
import random

import pytest

from ridgeline.llm import toxicity

WORDS = ["gromblat", "idiot", "this", "latter", "groin", "blatant", "gras", "mañana", "über", "lot", "flat", "oblat", "romb"]


@pytest.fixture(scope="module")
def letters():
    held = {}
    for w in WORDS * 20:
        for i in range(len(w) + 1):
            gram = ("  " + w + " ")[i : i + 3]
            held[gram] = held.get(gram, 0) + 1
    return toxicity.Letters(held)


def price(model, token, choices):
    """The cost of one reading: what each character stands for, by the rule that a blank behind a blank is none."""
    two, cost = "  ", 0.0
    for c, extra in choices:
        cost += extra
        if c and not (c == " " and two[1] == " "):
            cost += model.cost(two, c)
            two = two[1] + c
    return cost + (model.cost(two, " ") if two[1] != " " else 0.0)


def every_reading(model, token):
    """Costs by text, from all ways through the lattice; a star's letters are those behind the one before."""
    best = {}

    def walk(lattice, done, last):
        if not lattice:
            text = "".join(c for c, _ in done)
            cost = price(model, token, done)
            best[text] = min(best.get(text, cost), cost)
            return
        options, masks = lattice[0]
        table = toxicity.symbol_table()
        more = [(c, 0.4) for c in model.behind[table[ord(last)]]] if masks else []
        for c, extra in options + more:
            walk(lattice[1:], [*done, (c, extra)], c if c and not (c == " " and last == " ") else last)

    walk(toxicity.readings_of(token), [], " ")
    return best


@pytest.mark.parametrize("token", ["gr0m", "i d i o t", "idiiot", "l@t", "fl4t!", "g**m", "l*t", "l**t", "i*i0t", "ídiöt", "іdіоt", "bl4т", "r-o-m", "g*s*", "m4ñ*na", "l.*t"])
def test_likeliest_reading(letters, token):
    found = toxicity.restored(token, letters)
    every = every_reading(letters, token)
    least = min(every.values())
    same = [t for t, c in every.items() if abs(c - least) < 1e-9]
    assert " ".join(found.split()) in {" ".join(t.split()) for t in same}


def test_masks_of_any_length(letters):
    """A star for each letter, or more stars than letters; other words and rules of stars stay as they are."""
    own = toxicity.Restorer(letters, words=["gromblat", "idiot"])
    for text in ("g***blat", "g****lat", "gr*mbl*t", "g******t", "gr**********at", "gromb***********t", "i***t", "і***t", "gr0mb**t"):
        assert {"gromblat", "idiot"} & set(own.words(f"what a {text} here").split()), text
    assert "gromblat" not in own.words("a * b and ***** good*bad g*x") and own.words("*bold* words") == ""
    long = "g" + "*" * 50_000 + "t"
    assert toxicity.Restorer(letters).reading(long)[0] == "g" and own.reading(long) == "gromblat"


def test_other_letters(letters):
    """Marks and other scripts; words that are written with marks keep them."""
    own = toxicity.Restorer(letters)
    for text in ("ġromblat", "groмblat", "grömbläť", "іdiot", "ıdιoт"):
        assert own.words(text) in ("gromblat", "idiot"), text
    assert own.words("mañana über") == ""


def test_gate_changes_no_score(letters):
    """With the gate the words of the features are read wherever decoding everything reads them."""
    features = ["gromblat", "idio", "grom", "flat"]
    rng = random.Random(6)
    instead = {"g": "9", "o": "0о", "a": "4@äа", "i": "1!í", "t": "7+т", "l": "1|", "m": "м", "s": "5$", "e": "3é"}

    def disguise(word):
        out = []
        for c in word:
            c = rng.choice(instead[c]) if c in instead and rng.random() < 0.4 else c
            out.append(c * rng.choice((1, 1, 1, 2, 4)) + rng.choice(("", "", "", ".", "-", " ")))
        return "".join(out).strip()

    texts = [" ".join(disguise(rng.choice(WORDS)) for _ in range(6)) for _ in range(400)]
    gated, plain = toxicity.Restorer(letters, toxicity.Gate(features)), toxicity.Restorer(letters)
    held = lambda readings: sorted(f for r in readings.split() for f in features if r.startswith(f))
    some = 0
    for text in texts:
        assert held(gated.words(text)) == held(plain.words(text)), text
        some += bool(held(plain.words(text)))
    assert some > 100


def test_costs_are_a_distribution(letters):
    import numpy as np

    total = np.exp(-letters.costs).sum(2)
    assert (total < 2.5).all() and letters.count("idi") == 20
    assert all(len(set(p)) == 3 for p in itertools.permutations("abc"))


def test_names_found_once_are_gone(spark):
    """A full name behind one phrase leaves no trace in its text, in capitals neither; other words and texts stay."""
    from ridgeline.llm import pii

    texts = [
        "My name is Jane Doe. Later Jane Doe signed; Ms Doe left. JANE DOE was here, and Jane Doer.", "Nothing about May or Doe here.", None, "",
        "Mr John Smith met JOHN SMITH; then John Smith and Mr Smith spoke.", "Mr May came in May.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in pii.replaced(docs, "secret").collect()}
    assert "Jane Doe " not in got[0] and "Jane Doe." not in got[0] and "JANE DOE" not in got[0] and "Ms Doe" not in got[0] and got[0].endswith("and Jane Doer.")
    assert got[1] == texts[1] and got[2] is None and got[3] == "" and got[5].endswith("came in May.") and not got[5].startswith("Mr May")
    assert "smith" not in got[4].lower()
    first = got[4].split(" met ")[0].removeprefix("Mr ")
    assert got[4].split(" met ")[1].split(";")[0] == first.upper() and f"then {first} and" in got[4]
    other = {r.doc_id: r.text for r in pii.replaced(docs, "another").collect()}
    assert other[0] != got[0] and pii.secret_key(spark) == pii.secret_key(spark) != "ridgeline"
