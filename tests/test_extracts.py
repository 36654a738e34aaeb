"""Extracts in any number of files and splits, lines against boxes, centroids, features, nearest nodes of crowds."""

from __future__ import annotations

import io
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.functions.geometry import centroid, is_ring, meets_box
from ridgeline.operators import nearest
from ridgeline.sources import extract, osm


def node(i, lat=49.2, lon=20.0, **tags):
    return {"type": "node", "id": i, "lat": lat, "lon": lon, "tags": tags}


def way(i, nodes, **tags):
    return {"type": "way", "id": i, "nodes": nodes, "tags": tags}


ELEMENTS = [
    node(1, name='brace { and "quote" \\ ', note="line\nbreak"), node(2, 49.21, 20, name="Żółć {"), {"type": "node", "id": 3, "lat": 49.22, "lon": 20.02},
    {"type": "relation", "id": 5, "members": [{"type": "way", "ref": 7, "role": "outer"}, {"type": "node", "ref": 1, "role": ""}], "tags": {"type": "route", "id": "9"}}, way(7, [1, 2, 3], highway="path"), way(8, list(range(60)), highway="track"),
]


@pytest.mark.parametrize("shape", ["indented", "minified", "lines"])
def test_every_split_gives_each_element_once(shape):
    """Whatever the size of splits; an element belongs to the split in which it begins."""
    document = {"version": 0.6, "generator": "made {up} here", "elements": ELEMENTS * 3}
    text = {"indented": json.dumps(document, indent=2, ensure_ascii=False), "minified": json.dumps(document), "lines": "\n".join(json.dumps(x) for x in ELEMENTS * 3)}[shape]
    raw = text.encode()
    for split in (1, 37, 200, 1000, len(raw), 10 * len(raw)):
        got = []
        for s in range(0, len(raw), split):
            got += extract.elements(io.BytesIO(raw), s, min(len(raw), s + split), len(raw))
        assert got == ELEMENTS * 3, split
    extract_piece, extract.PIECE = extract.PIECE, 7
    try:
        assert list(extract.elements(io.BytesIO(raw), 0, len(raw), len(raw))) == ELEMENTS * 3
    finally:
        extract.PIECE = extract_piece
    with pytest.raises(json.JSONDecodeError):
        list(extract.elements(io.BytesIO(raw[: raw.rindex(b"track")]), 0, raw.rindex(b"track"), raw.rindex(b"track")))
    assert list(extract.elements(io.BytesIO(b""), 0, 0, 0)) == []


def test_order_of_files(spark, tmp_path):
    """The first way of a pair wins, by the names of files, also when a later file is larger; one file gives the same."""
    first = [way(100, [1, 2], highway="path", sac_scale="hiking", name="first")]
    later = [node(1), node(2, 49.21), *[node(i) for i in range(10, 400)], way(200, [2, 1], highway="path", sac_scale="alpine_hiking", name="later")]
    write = lambda folder, name, rows, lines=False: (folder / name).write_text("\n".join(map(json.dumps, rows)) if lines else json.dumps({"elements": rows}, indent=1))
    for name in ("many", "one", "lines"):
        (tmp_path / name).mkdir()
    write(tmp_path / "many", "a.json", first)
    write(tmp_path / "many", "b.json", later)
    write(tmp_path / "one", "all.json", first + later)
    write(tmp_path / "lines", "a.jsonl", first, True)
    write(tmp_path / "lines", "b.jsonl", later, True)
    for name, lines, split in (("many", False, 1 << 20), ("many", False, 500), ("one", False, 300), ("lines", True, 0)):
        osm_rows = osm.read_extract(spark, str(tmp_path / name), lines, split)
        _, edges = osm.full_map(osm_rows)
        assert [(r.osm_way_id, r.difficulty, r.trail_name) for r in edges.collect()] == [("way/100", 1, "first")], (name, split)
        plan = osm_rows.filter("type = 'way'")._jdf.queryExecution().toString()
        assert "EqualTo(type,way)" in plan
    assert extract.read_documents(spark, str(tmp_path / "many"), kinds=("way",)).count() == 2
    with pytest.raises(Exception, match="FileNotFound|nowhere"):
        extract.read_documents(spark, str(tmp_path / "nowhere")).count()


def test_null_and_missing_parts_of_elements(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"elements": [{"type": "node", "id": 1, "lat": 1, "lon": 2, "tags": {"a": null, "b": 3}}, {"type": "way", "id": 2}, {"type": "count", "id": 0}, {"id": 5}]}')
    got = osm.read_extract(spark, str(tmp_path / "x.json")).orderBy("ord").collect()
    assert [(r.type, r.id, r.lat, r.tags, r.nodes) for r in got] == [("node", 1, 1.0, {"a": None, "b": "3"}, None), ("way", 2, None, None, None)]


def test_ways_that_cross_the_box(spark):
    """Between two nodes outside too, but not past a corner; a gap of an unknown node breaks the line."""
    box = (49.0, 20.0, 49.1, 20.1)
    nodes = [(1, 48.95, 20.05), (2, 49.15, 20.05), (3, 48.99, 20.09), (4, 49.02, 20.14), (5, 49.1, 20.1), (6, 49.2, 20.2), (7, 49.05, 19.0), (8, 49.05, 19.5)]
    ways = {10: [1, 2], 11: [3, 4], 12: [5, 6], 13: [7, 8], 14: [1, 99, 2], 15: [1, 1], 16: [7, 8, 6, 2, 1]}
    rows = [("node", i, lat, lon, None, {}, i) for i, lat, lon in nodes] + [("way", i, None, None, n, {"highway": "path"}, i) for i, n in ways.items()] + [("way", 10, None, None, [1, 2, 3], {"highway": "path"}, 90)]
    data = spark.createDataFrame(rows, "type string, id bigint, lat double, lon double, nodes array<bigint>, tags map<string,string>, ord bigint")
    kept = osm.selected(data, box)
    assert kept.columns == data.columns
    assert sorted((r.id, r.nodes) for r in kept.filter("type = 'way'").collect()) == [(10, [1, 2]), (12, [5, 6]), (16, [7, 8, 6, 2, 1])]
    assert sorted(r.id for r in kept.filter("type = 'node'").collect()) == [1, 2, 5, 6, 7, 8]
    # against many points of the line
    rng = random.Random(1)
    lines = [tuple(rng.uniform(-0.1, 0.2) for _ in range(4)) for _ in range(400)]
    found = spark.createDataFrame(lines, "a double, b double, c double, d double").select("*", meets_box(F.col("a"), F.col("b"), F.col("c"), F.col("d"), (0.0, 0.0, 0.1, 0.1)).alias("met")).collect()
    for r in found:
        met = any(0 <= r.a + t / 2000 * (r.c - r.a) <= 0.1 and 0 <= r.b + t / 2000 * (r.d - r.b) <= 0.1 for t in range(2001))
        assert r.met or not met
        assert met == r.met or min(abs(x) for x in (r.a, r.b, r.c, r.d)) < 1 and r.met  # grazes between two of the 2001 points
    assert sum(r.met for r in found) > 50


SHAPE = "rings array<array<struct<lat:double,lng:double>>>, holes array<array<struct<lat:double,lng:double>>>, area boolean"


def test_centroids(spark):
    square = [(49.0, 20.0), (49.0, 20.1), (49.1, 20.1), (49.1, 20.0), (49.0, 20.0)]
    uneven = [(49.0, 20.0), (49.0, 20.02), (49.0, 20.03), (49.0, 20.1), (49.1, 20.1), (49.1, 20.0), (49.0, 20.0)]
    hole = [(49.0, 20.0), (49.1, 20.0), (49.1, 20.05), (49.0, 20.05), (49.0, 20.0)]
    cases = [
        ([square], [], True, (49.05, 20.05)), ([uneven], [], True, (49.05, 20.05)), ([uneven[::-1]], [], True, (49.05, 20.05)), ([square], [hole], True, (49.05, 20.075)), ([square], [hole[::-1]], True, (49.05, 20.075)),
        ([[(49.0, 20.0), (49.0, 20.1), (49.3, 20.1)]], [], False, (49.1125, 20.0875)), ([[(49.0, 20.0)]], [], False, (49.0, 20.0)), ([[(49.0, 20.0)] * 4], [], True, (49.0, 20.0)), ([[(49.0, 20.0), (49.2, 20.2), (49.0, 20.0), (49.0, 20.0)]], [], True, (49.1, 20.1)),
        ([square, [(49.0, 30.0), (49.0, 30.1), (49.1, 30.1), (49.1, 30.0), (49.0, 30.0)]], [], True, (49.05, 25.05)), ([uneven], [], False, (49.05, 20.05)), ([square], None, True, (49.05, 20.05)),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, " + SHAPE)
    for r in df.select("i", centroid(F.col("rings"), F.col("holes"), F.col("area")).alias("c"), is_ring(F.col("rings")[0]).alias("ring")).collect():
        assert (r.c.lat, r.c.lng) == pytest.approx(cases[r.i][3], abs=1e-9), r.i
        assert r.ring == (len(cases[r.i][0][0]) >= 4 and cases[r.i][0][0][0] == cases[r.i][0][0][-1])


def test_features(spark, tmp_path):
    """Nodes, closed and open ways, and a lake whose rim is of two ways with an island; unnamed and unknown things drop out."""
    rim = {1: (49.0, 20.0), 2: (49.0, 20.1), 3: (49.1, 20.1), 4: (49.1, 20.0), 5: (49.02, 20.01), 6: (49.02, 20.02), 7: (49.03, 20.02)}
    member = lambda ref, role="outer": {"type": "way", "ref": ref, "role": role}
    rows = [node(i, *p) for i, p in rim.items()] + [
        way(20, [1, 2, 3]), way(21, [1, 4, 3]), way(22, [5, 6, 7, 5]), way(23, [1, 2, 3, 4, 1], natural="water", name="Staw"), way(24, [1, 2, 3, 4, 1], waterway="waterfall", name="Siklawa"), way(25, [1, 99], tourism="viewpoint", name="Half"), way(26, [98, 99], natural="peak", name="Gone"),
        {"type": "relation", "id": 30, "tags": {"type": "multipolygon", "natural": "water", "name": "Jezioro"}, "members": [member(20), member(22, "inner"), member(21)]}, {"type": "relation", "id": 31, "tags": {"type": "multipolygon", "natural": "water", "name": "Open"}, "members": [member(20)]},
        node(40, 49.05, 20.05, natural="peak", name="Top"), node(41, 49.05, 20.05, natural="peak"), node(42, natural="tree", name="No"),
    ]
    (tmp_path / "f.json").write_text(json.dumps({"elements": rows}))
    osm_rows = osm.read_extract(spark, str(tmp_path / "f.json"))
    found = {(r.type, r.id): r for r in osm.features(osm_rows).collect()}
    assert sorted(found) == [("node", 40), ("node", 41), ("relation", 30), ("way", 23), ("way", 24), ("way", 25)]
    assert len(found["relation", 30].rings[0]) == 5 and len(found["relation", 30].holes) == 1
    nodes = spark.createDataFrame([("node/1", 49.0, 20.0, 1)], "id string, lat double, lng double, ord bigint")
    points = {r.name: (r.id, r.lat, r.lng) for r in osm.points_of_interest(osm.features(osm_rows), nodes).collect()}
    assert points["Staw"] == ("way/23", 49.05, 20.05) and points["Top"] == ("node/40", 49.05, 20.05) and points["Half"] == ("way/25", 49.0, 20.0)
    a, b = 0.01, 0.01 * 0.01 / 2
    lat = (0.05 * a - (0.02 + 0.02 + 0.03) / 3 * b) / (a - b)
    assert points["Jezioro"][1] == pytest.approx(49 + lat, abs=1e-6)
    assert osm.points_of_interest(osm.features(osm_rows.limit(0)), nodes).count() == 0


def haversine(p, q):
    lat1, lng1, lat2, lng2 = map(math.radians, (*p, *q))
    a = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lng2 - lng1) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


@pytest.mark.parametrize("case", ["two crowds", "globe"])
def test_nearest_in_cells(spark, case):
    """Two crowds far apart meet few leaves a point, and so do points at the edge of the map and at the poles; equal to a search of all."""
    rng = random.Random(3)
    if case == "two crowds":
        spots = [(rng.gauss(49.2, 1e-4), rng.gauss(20.0, 1e-4)) for _ in range(1500)] + [(rng.gauss(-30, 1e-4), rng.gauss(-70, 1e-4)) for _ in range(1500)]
        points = [(rng.gauss(49.2, 2e-4), rng.gauss(20.0, 2e-4)) for _ in range(200)] + [(rng.gauss(-30, 2e-4), rng.gauss(-70, 2e-4)) for _ in range(200)] + [(0.0, 0.0)]
    else:
        spots = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(1500)] + [(90.0, 0.0), (-90.0, 5.0), (0.0, 180.0), (0.0, -180.0)]
        points = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(250)] + [(89.99, 170.0), (-89.9, -3.0), (0.0, 179.99), (0.01, -179.99), (90.0, 90.0), *spots[:5]]
    spots += spots[:20] * 30  # many nodes at one place: the first in the file counts
    nodes = spark.createDataFrame([(f"n{i}", *p, i) for i, p in enumerate(spots)] + [("none", None, 1.0, -1)], "id string, lat double, lng double, ord bigint")
    asked = spark.createDataFrame([(f"p{i}", *p) for i, p in enumerate(points)] + [("none", None, None)], "id string, lat double, lng double")
    got = {r.id: r for r in nearest.nearest(asked, nodes, leaf=16).collect()}
    assert len(got) == len(points)
    for i, p in enumerate(points):
        best = min((haversine(p, q), k) for k, q in enumerate(spots))
        assert got[f"p{i}"].km == pytest.approx(best[0], abs=1e-9)
        assert got[f"p{i}"].node_id == f"n{best[1]}" or haversine(p, spots[int(got[f"p{i}"].node_id[1:])]) == pytest.approx(best[0], abs=1e-11)
    known = nodes.filter("lat is not null").select(F.col("id").alias("node_id"), F.col("lat").alias("nlat"), F.col("lng").alias("nlng"), "ord").dropDuplicates(["nlat", "nlng"])
    levels, leaves, n = nearest.cell_tree(known, 16)
    assert leaves.groupBy("level", "row", "column").count().agg(F.max("count")).first()[0] <= 16
    assert leaves.count() == known.count()
    met = nearest.candidates(asked.filter("lat is not null"), levels, "id", n).join(leaves, ["level", "row", "column"])
    assert met.count() <= 150 * len(points)
