"""Operator 7, PII surrogates: keyed, type-consistent replacements with collision checks, in DataFrame functions only.

Entities are found by patterns, one pass over each text. Each consists of parts: a name of a given and a family name, an email
of what stands before and behind the @ (case makes no difference there), any other entity of itself. Every distinct part gets a
surrogate from a keyed digest of its value: digits stay digits, letters stay letters of their script and case, card numbers keep
their check digit valid or invalid as it was, addresses stay in range, given names keep the gender that title or name tells and
their script. Equal parts get equal surrogates everywhere, so a family name and a domain stay the same in all entities that hold
them: coreference holds, also behind a collision, and a full name found once in a text is replaced everywhere in it, in
capitals too. Surrogates that two parts of any types share, or that occur as a part in the
corpus, are drawn again, from a space that grows with every draw, until all are distinct; after ATTEMPTS draws what is left is
numbered, so the rounds always end.

Edge cases: null texts stay null and empty ones empty; repeated rows are treated alike; an entity of any number of rows is
one row of the entity table; an empty table gives an empty result; other columns pass through, whatever their names; a text of
any length is read whole.
"""

from __future__ import annotations

import secrets
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import dropped, written

# Titles and given names by the gender they tell, in Latin and in Cyrillic script.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Señor", "Sr", "Don", "Monsieur", "Господин", "Г-н"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Sra", "Doña", "Madame", "Mme", "Mademoiselle", "Mlle", "Госпожа", "Г-жа"),
    "n": ("Dr", "Prof", "Professor", "Доктор"),
}
GIVEN = {
    "m": ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Paul", "Hans", "Klaus", "Pierre", "Jean", "Luis", "Carlos", "José"),
    "f": ("Mary", "Anna", "Linda", "Susan", "Laura", "Emma", "Julia", "Sarah", "Maria", "Claire", "Sophie", "Carmen", "Lucía", "Greta", "Helga", "Elena"),
}
GIVEN_CYRILLIC = {
    "m": ("Иван", "Пётр", "Сергей", "Дмитрий", "Андрей", "Николай", "Михаил", "Олег"),
    "f": ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана"),
}
SYLLABLES = ("ba", "de", "fi", "go", "ku", "la", "me", "ni", "po", "ra", "se", "ti", "vo", "wa", "ze", "mor")
SYLLABLES_CYRILLIC = ("ба", "де", "фи", "го", "ку", "ла", "ме", "ни", "по", "ра", "се", "ти", "во", "га", "зе", "мор")
#: Draws of a part before it is numbered; from the WIDER-th on letters or digits are added.
ATTEMPTS, WIDER = 12, 3
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя"

NAME = r"\p{Lu}[\p{L}'’-]++"
_TITLE = "|".join(t for g in TITLES.values() for t in g)
_GIVEN = "|".join(n for table in (GIVEN, GIVEN_CYRILLIC) for g in table.values() for n in g)
#: Pattern of each type. The first that fits the whole entity names its type.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "address": r"(?<![\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "address6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "phone": r"(?<![\p{N}+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d{4}(?:[ -]\d{4}){3}(?!\d)|(?<!\d)\d{13,19}(?!\d)",
    "account": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:(?=[A-Fa-f]*+\d)[0-9A-Fa-f]{32,128}|sk-[A-Za-z0-9]{16,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+)(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLE})\.? (?:{NAME} )?{NAME}|(?:{_GIVEN}) {NAME})|(?<=\b(?:[Nn]ame is |[Nn]ame: |Signed, |Dear |Contact: )){NAME} {NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def entity_type(value: Column) -> Column:
    """The type of an entity. What must not stand beside it doesn't; names told by the words before them have lost those."""
    types = [F.when(value.rlike(f"^(?:{p})$"), F.lit(kind)) for kind, p in PATTERNS.items()]
    return F.coalesce(*types, F.when(value.rlike(f"^{NAME} {NAME}$"), F.lit("name")), F.lit("secret"))


def _digest(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """256 keyed hexadecimal digits."""
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"), F.lit(str(i))), 256) for i in range(4)])


def _draw(stream: Column, at: Column, n: int) -> Column:
    """A number below n from the stream's digits at ``at``; far positions fold back and shift by their lap."""
    place = F.pmod(at * 2, F.lit(252)) + 1
    return F.pmod(F.conv(F.substring(stream, place, 4), 16, 10).cast("int") + F.floor(at / 126).cast("int"), F.lit(n)).cast("int")


def _letter(alphabet: str, stream: Column, at: Column) -> Column:
    return F.substring(F.lit(alphabet), _draw(stream, at, len(alphabet)) + 1, 1)


def _like(value: Column, stream: Column, hexadecimal: Column) -> Column:
    """``value`` with every digit and letter replaced by one of its kind; all else stays."""

    def one(ch: Column, i: Column) -> Column:
        latin = F.when(hexadecimal, _letter("abcdef", stream, i)).otherwise(_letter(LATIN, stream, i))
        cyrillic = F.lower(ch).rlike(r"\p{IsCyrillic}")
        letter = F.when(cyrillic, _letter(CYRILLIC, stream, i)).otherwise(latin)
        return F.when(ch.rlike(r"\p{Nd}"), _draw(stream, i, 10).cast("string")).when(ch.rlike(r"\p{Lu}"), F.upper(letter)).when(ch.rlike(r"\p{L}"), letter).otherwise(ch)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(value: Column) -> Column:
    """The sum of the digits of a card number, those at even places from the right doubled."""
    digits = F.reverse(F.filter(F.split(value, ""), lambda c: c.rlike(r"\d")))
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _card(value: Column, stream: Column) -> Column:
    """Digits for digits; the last one is set so that the check is valid if and only if it was."""
    drawn = _like(value, stream, F.lit(False))
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    missing = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    check = F.when(F.pmod(_luhn(value), F.lit(10)) == 0, missing).otherwise(F.pmod(missing + 1 + _draw(stream, F.lit(120), 9), F.lit(10)))
    return F.concat(body, check.cast("string"))


def _gender(title: Column, given: Column) -> Column:
    """m, f or n, by the title or else by the given name."""
    bare, women, men = F.regexp_replace(title, r"\.? $", ""), given.isin(*GIVEN["f"], *GIVEN_CYRILLIC["f"]), given.isin(*GIVEN["m"], *GIVEN_CYRILLIC["m"])
    return F.when(bare.isin(*TITLES["f"]), "f").when(bare.isin(*TITLES["m"]), "m").when(women, "f").when(men, "m").otherwise("n")


def _at(stream: Column, place: int, n: int) -> Column:
    """A place from 1 to n from the stream's digits."""
    return (F.pmod(F.conv(F.substring(stream, place, 5), 16, 10).cast("int"), F.lit(n)) + 1).cast("int")


def _syllables(stream: Column, cyrillic: Column, begin: int, n: Column) -> Column:
    """A capitalised word of ``n`` syllables."""
    made = lambda table: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(F.array(*map(F.lit, table)), (F.conv(F.substring(stream, begin + i, F.lit(1)), 16, 10).cast("int") + 1))), "")
    return F.initcap(F.when(cyrillic, made(SYLLABLES_CYRILLIC)).otherwise(made(SYLLABLES)))


def _given(value: Column, stream: Column, more: Column) -> Column:
    """A given name of the gender and script told by the part's first letters; beyond the list, with syllables behind a hyphen."""
    gender, cyrillic = F.substring(value, 1, 1), F.substring(value, 3, 1).rlike(r"\p{IsCyrillic}")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), _at(stream, 1, len(names)))
    of = lambda table: F.when(gender == "f", pick(table["f"])).when(gender == "m", pick(table["m"])).otherwise(pick(table["f"] + table["m"]))
    listed = F.when(cyrillic, of(GIVEN_CYRILLIC)).otherwise(of(GIVEN))
    return F.when(more > 0, F.concat_ws("-", listed, _syllables(stream, cyrillic, 7, F.least(more + 1, F.lit(12))))).otherwise(listed)


def parts_of(kind: Column, value: Column) -> Column:
    """The parts (kind, value) of an entity, in order; given names carry the gender before them."""
    part = lambda k, v: F.struct(F.lit(k).alias("kind") if isinstance(k, str) else k.alias("kind"), v.alias("value"))
    title, rest = title_of(value), F.split(F.substring(value, F.length(title_of(value)) + 1, F.length(value)), " ")
    given, family = part("given", F.concat_ws("|", _gender(title, F.element_at(rest, 1)), F.element_at(rest, 1))), part("family", F.element_at(rest, -1))
    low = F.lower(value)
    mail = F.array(part("local", F.substring_index(low, "@", 1)), part("domain", F.substring_index(low, "@", -1)))
    return F.when(kind == "email", mail).when((kind == "name") & (F.size(rest) > 1), F.array(given, family)).when(kind == "name", F.array(family)).otherwise(F.array(part(kind, value)))


def title_of(value: Column) -> Column:
    """The title of a name with the blank behind it, or nothing."""
    return F.regexp_extract(value, rf"^(?:{_TITLE})\.? ", 0)


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The replacement of a part at its ``attempt``-th draw."""
    stream = _digest(key, kind, value, attempt)
    more = F.greatest(attempt - (WIDER - 1), F.lit(0))
    extra = F.when(more > 0, F.substring(stream, F.lit(200), F.least(more, F.lit(40)))).otherwise("")
    end = F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), _at(stream, 250, 3))
    domain = F.concat(_like(F.substring_index(value, ".", 1), F.reverse(stream), F.lit(False)), extra, F.lit(".example."), end)
    address = F.concat_ws(".", *[(_draw(stream, F.lit(7 * i), 254) + 1).cast("string") for i in range(4)])
    country = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])|^[A-Z]{2}(?=\d)", 0)
    kept = F.concat(country, _like(F.substring(value, F.length(country) + 1, F.length(value)), stream, F.lit(False)))
    head = F.regexp_extract(value, r"^(?:sk-|AKIA|gh[pousr]_)", 0)
    secret = F.concat(head, _like(F.substring(value, F.length(head) + 1, F.length(value)), stream, value.rlike("^[0-9A-Fa-f]+$")))
    return (
        F.when(kind == "domain", domain).when(kind == "local", F.concat(_like(value, stream, F.lit(False)), extra)).when(kind == "given", _given(value, stream, more))
        .when(kind == "family", _syllables(stream, value.rlike(r"^\p{IsCyrillic}"), 20, F.lit(5) + F.least(more, F.lit(20)))).when(kind == "address", address).when(kind == "address6", _like(value, stream, F.lit(True)))
        .when(kind == "card", _card(value, stream)).when(kind.isin("phone", "account"), kept).when(kind == "secret", F.concat(secret, extra)).otherwise(_like(value, stream, F.lit(False)))
    )


def part_surrogates(parts: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for the distinct ``parts`` (kind, value): all surrogates distinct, and none a part."""
    drawn = parts.select("kind", "value", F.lit(0).alias("attempt"))
    drawn = written(drawn.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)), "surrogates")
    real = parts.select(F.when(F.col("kind") == "given", F.substring_index("value", "|", -1)).otherwise(F.col("value")).alias("surrogate")).distinct()
    while True:
        rank = F.struct("attempt", "kind", "value")
        shared = drawn.groupBy("surrogate").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).filter("n > 1")
        twice = drawn.join(shared, "surrogate").filter(rank != F.col("first")).select("kind", "value")
        # a listed given name may well be somebody's: with another family name it tells nothing
        taken = drawn.filter("kind <> 'given'").join(real, "surrogate", "left_semi").select("kind", "value")
        again = written(twice.unionByName(taken).distinct().withColumn("again", F.lit(1)), "collisions")
        if again.isEmpty():
            dropped(again)
            return drawn
        moved = drawn.join(again, ["kind", "value"], "left").select("kind", "value", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"), F.col("surrogate").alias("old"), "again")
        numbered = F.concat(F.col("old"), F.lit("~"), F.monotonically_increasing_id().cast("string"))  # no pattern finds a ~
        fresh = F.when(F.col("again").isNull(), F.col("old")).when(F.col("attempt") > ATTEMPTS, numbered).otherwise(surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key))
        new = written(moved.select("kind", "value", "attempt", fresh.alias("surrogate")), "surrogates")
        dropped(drawn, again)
        drawn = new


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for the distinct ``entities`` (kind, value), put together from the surrogates of their parts."""
    split = written(entities.select("kind", "value", F.posexplode(parts_of(F.col("kind"), F.col("value"))).alias("at", "part")), "parts")
    drawn = part_surrogates(split.select("part.kind", "part.value").distinct(), key)
    named = drawn.select(F.struct("kind", "value").alias("part"), "surrogate")
    made = split.join(named, "part").groupBy("kind", "value").agg(F.sort_array(F.collect_list(F.struct("at", "surrogate")))["surrogate"].alias("made"))  # two parts at most
    whole = F.when(F.col("kind") == "email", F.array_join("made", "@")).when(F.col("kind") == "name", F.concat(title_of(F.col("value")), F.array_join("made", " "))).otherwise(F.col("made")[0])
    return made.select("kind", "value", whole.alias("surrogate"))


def secret_key(spark: SparkSession) -> str:
    """The key in ``spark.ridgeline.surrogate.key``; where that is unset, one that is drawn for this application and kept nowhere."""
    return spark.conf.get("spark.ridgeline.surrogate.key", None) or _drawn_key(spark.sparkContext.applicationId)


@lru_cache(maxsize=8)
def _drawn_key(app: str) -> str:
    return secrets.token_hex(16)


def _elsewhere(text: Column, names: Column) -> Column:
    """The text with names of two words or more that were found in it (value, surrogate) replaced wherever else they stand, in capitals too."""
    bare = lambda c: F.substring(c, F.length(title_of(c)) + 1, F.length(c))
    whole = lambda v: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), v, F.lit(r"\E(?![\p{L}\p{N}])"))
    pairs = F.filter(F.transform(names, lambda x: F.struct(bare(x["value"]).alias("value"), bare(x["surrogate"]).alias("surrogate"))), lambda x: F.contains(x["value"], F.lit(" ")))
    once = lambda t, v, s: F.when(F.contains(t, v), F.regexp_replace(t, whole(v), s)).otherwise(t)
    return F.aggregate(F.array_distinct(pairs), text, lambda t, x: once(once(t, x["value"], x["surrogate"]), F.upper(x["value"]), F.upper(x["surrogate"])))


def replaced(docs: DataFrame, key: str, counts: bool = False) -> DataFrame:
    """docs (doc_id, text and others) with surrogates in ``text``; with ``counts`` also n_entities.

    ``key`` is a secret: who has it can make the surrogates of any value. A full name that a pattern finds once in a text is
    replaced everywhere in that text, also where no pattern finds it.
    """
    ids = [F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id")]
    whole = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(ids[0].alias("k1"), ids[1].alias("k2"), F.posexplode(F.regexp_extract_all(whole, F.lit(ANY), 0)).alias("pos", "value"))
    mentions = written(found.distinct().withColumn("kind", entity_type(F.col("value"))), "mentions")
    table = written(surrogates(mentions.select("kind", "value").distinct(), key), "entities")
    per_doc = mentions.join(table, ["kind", "value"]).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("pos", "surrogate", "kind", "value"))).alias("found"))
    per_doc = per_doc.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("found.surrogate").alias("_new"), F.filter("found", lambda x: x["kind"] == "name").alias("_names"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), ids[0].alias("_a"), ids[1].alias("_b"))
    both = rows.join(per_doc, (F.col("_a") == F.col("_k1")) & (F.col("_b") == F.col("_k2")), "left")
    pieces = F.split(F.col("_row.text"), ANY, -1)
    text = F.when(F.col("_new").isNull(), F.col("_row.text")).otherwise(F.array_join(F.zip_with(pieces, F.col("_new"), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), ""))
    text = F.when(F.size("_names") > 0, _elsewhere(text, F.col("_names"))).otherwise(text)
    columns = [text.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return both.select(*columns, *([F.coalesce(F.size("_new"), F.lit(0)).cast("long").alias("n_entities")] if counts else []))


def leftovers(docs: DataFrame) -> Column:
    """Whether a text still holds anything that the patterns find."""
    return reduce(lambda a, p: a | docs["text"].rlike(p), PATTERNS.values(), F.lit(False))
