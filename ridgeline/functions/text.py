"""Column expressions for names and labels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and placeholders.
LABELS = {"time": "czas", "distance": "dystans", "difficulty": "trudność"}
NO_LABEL, NO_DATA, POINT = "brak", "brak danych", "punkt"
PREFERENCES = {"shortest": "distance", "fastest": "time", "easy": "difficulty", "balanced": "time"}
NODE_TYPES = ("tourism", "natural", "place", "waterway", "highway")
POI_TYPES = ("natural", "tourism", "waterway")


def _folding() -> tuple[str, str]:
    """Lower-case letters with marks that Unicode takes apart into one letter and marks of the combining block, and that letter."""
    pairs = []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and chr(code) == chr(code).lower() and all("̀" <= c <= "ͯ" for c in parts[1:]):
            pairs.append((chr(code), parts[0]))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


_MARKED, _PLAIN = _folding()


def fold_text(value: Column) -> Column:
    """Lower case without accents; letters that have no parts, such as the Polish l with stroke, stay. Null is empty."""
    return F.translate(F.lower(F.coalesce(value, F.lit(""))), _MARKED, _PLAIN)


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])


def point_name(name: Column, label: Column, title: Column, id_: Column) -> Column:
    """Name, label, title or id, else empty."""
    return F.coalesce(first_filled(name, label, title, id_), F.lit(""))


def is_generic(name: Column) -> Column:
    """Whether a name is a placeholder with a number."""
    return F.trim(name).rlike(r"(?i)^Punkt\s+\d+$")


def is_characteristic(name: Column) -> Column:
    """Whether a name tells something."""
    return F.coalesce((F.trim(name) != "") & ~is_generic(name), F.lit(False))


def minutes_text(minutes: Column) -> Column:
    """45 min, 2 h, 2 h 15 min."""
    hours, rest = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("long").cast("string")
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).when(minutes % 60 == 0, F.concat(hours, F.lit(" h"))).otherwise(F.concat(hours, F.lit(" h "), rest, F.lit(" min")))


def one_decimal(value: Column) -> Column:
    """The value with one decimal."""
    return F.format_string("%.1f", value)


def _looked_up(value: Column, table: dict[str, str], otherwise: Column) -> Column:
    out = otherwise
    for key, found in table.items():
        out = F.when(value == key, F.lit(found)).otherwise(out)
    return out


def criterion_label(criterion: Column) -> Column:
    """The label of a criterion; elevation has none."""
    return _looked_up(criterion, LABELS, F.lit(NO_LABEL))


def preferred_criterion(preference: Column, current: Column) -> Column:
    """The criterion that a preference asks for, else the current one."""
    return _looked_up(preference, PREFERENCES, current)


def shown_elevation(elevation: Column) -> Column:
    """The elevation, or a placeholder where it is missing or 0."""
    return F.when(F.coalesce(elevation, F.lit(0)) == 0, F.lit(NO_DATA)).otherwise(elevation.cast("string"))


def shown_type(kind: Column) -> Column:
    """The type, or a placeholder."""
    return F.coalesce(F.nullif(kind, F.lit("")), F.lit(POINT))


def joined_names(names: Column) -> Column:
    """The names with arrows between them."""
    return F.array_join(names, " → ")


def node_name(tags: Column, id_: Column) -> Column:
    """name:pl, name or alt_name, the first that is filled, else a placeholder with the id."""
    return F.coalesce(first_filled(tags["name:pl"], tags["name"], tags["alt_name"]), F.concat(F.lit("Punkt "), id_.cast("string")))


def waypoint_name(tags: Column, id_: Column) -> Column:
    """The name alone, empty or not, else a placeholder with the id."""
    return F.coalesce(tags["name"], F.concat(F.lit("Punkt "), id_.cast("string")))


def poi_name(tags: Column) -> Column:
    """name:pl, name or alt_name; null if there is none."""
    return F.coalesce(tags["name:pl"], tags["name"], tags["alt_name"])


def node_type(tags: Column) -> Column:
    """The first filled tag that tells a node's type, else waypoint."""
    return F.coalesce(first_filled(*[tags[t] for t in NODE_TYPES]), F.lit("waypoint"))


def poi_type(tags: Column) -> Column:
    """The first tag that tells a point of interest's type, else poi; natural goes before tourism here."""
    return F.coalesce(*[tags[t] for t in POI_TYPES], F.lit("poi"))


def osm_id(kind: Column, id_: Column) -> Column:
    """node/1, way/2."""
    return F.concat_ws("/", kind, id_.cast("string"))
