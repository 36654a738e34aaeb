"""Scalar expressions against the fixture values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import geo, numbers, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("value", "want"), [(None, 7), ("", 7), (" Unknown ", 7), ("none", 7), ("NULL", 7), (" 12 ", 12.0), ("1_000", 1000.0), ("1d", 7), ("abc", 7), ("-3.5", -3.5), ("\t4\n", 4.0)])
def test_as_number(spark, value, want):
    assert one(spark, numbers.as_number(F.lit(value).cast("string"), 7)) == want


def test_positions(spark):
    s = lambda a, b: one(spark, geo.server_position([F.lit(a).cast("string")], [F.lit(b).cast("string")]))
    assert tuple(s("0", "20")) == (None, None)
    assert tuple(s("49.2", "19.9")) == (49.2, 19.9)
    alias = geo.server_position([F.lit(None).cast("string"), F.lit("49.2")], [F.lit("19.9")])
    assert tuple(one(spark, alias)) == (49.2, 19.9)
    c = lambda a, b: tuple(one(spark, geo.client_position([F.lit(a).cast("string")], [F.lit(b).cast("string")])))
    assert c("0", "20") == (0.0, 20.0)
    assert c("", "1") == (0.0, 1.0)
    assert c(None, "1") == (None, 1.0)
    p = lambda *v: one(spark, geo.list_position(F.array(*map(F.lit, v))))
    assert tuple(p(0.0, 0.0)) == (0.0, 0.0)
    assert p(1.0) is None
    assert p(float("inf"), 1.0) is None


def test_fold_text(spark):
    fold = lambda v: one(spark, text.fold_text(F.lit(v).cast("string")))
    assert fold("Kościół Łaź") == "koscioł łaz"
    assert fold(None) == ""
    assert "malol" not in fold("Małołączniak")
    assert "małoł" in fold("Małołączniak")


@pytest.mark.parametrize(("name", "want"), [("Punkt 12", True), (" punkt 7 ", True), ("Punkt A", False), ("Punkt12", False)])
def test_generic(spark, name, want):
    assert one(spark, text.is_generic(F.lit(name))) is want


def test_walking(spark):
    walk = lambda m, g: one(spark, numbers.walking_minutes(F.lit(m), F.lit(g)))
    assert [walk(5000, 0), walk(5000, 600), walk(5000, -50), walk(2500, 5)] == [60, 120, 60, 30]
    assert [one(spark, numbers.flat_minutes(F.lit(k))) for k in (0.0, 1.0)] == [0.1, 15.0]
    assert [one(spark, numbers.sac_difficulty(F.lit(s).cast("string"))) for s in ("hiking", "difficult_alpine_hiking", "x", None)] == [1, 6, 1, 1]


def test_labels(spark):
    assert [one(spark, text.minutes_text(F.lit(m))) for m in (45, 120, 135)] == ["45 min", "2 h", "2 h 15 min"]
    assert [one(spark, text.preferred_criterion(F.lit(p), F.lit("elevation"))) for p in ("shortest", "fastest", "easy", "balanced", "")] == ["distance", "time", "difficulty", "time", "elevation"]


def test_haversine(spark):
    km = lambda *v: one(spark, geo.haversine_km(*map(F.lit, v)))
    assert km(49.2, 20.0, 49.2, 20.0) == 0
    assert km(49.2, 20.0, 49.9, 19.0) == pytest.approx(km(49.9, 19.0, 49.2, 20.0))
    assert km(0.0, 0.0, 1.0, 0.0) == pytest.approx(111.1949, abs=1e-4)
