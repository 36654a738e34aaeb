"""Containers, map extracts, search and the store."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ridgeline.operators import search, store
from ridgeline.sources import documents, osm, schemas
from ridgeline.streaming import changes


def test_containers(spark):
    cases = ['[{"id":"a"}]', '{"points":[{"id":"a"},{"id":"b"}]}', '{"nodes":{"a":{"lat":1}}}', '{"a":{"id":"z"}}', '{"a":{"lat":1},"v":3}', '"text"', None, "[]"]
    df = spark.createDataFrame(list(enumerate(cases)), "k int, value string")
    got = {}
    for r in documents.collection(df, "value", "id STRING, lat DOUBLE", "points", "nodes").orderBy("k", "ord").collect():
        got.setdefault(r.k, []).append(r.id)
    assert got == {0: ["a"], 1: ["a", "b"], 2: ["a"], 3: ["z"], 4: ["a"]}


def test_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"nodes": [{"id": "a", "name": "A", "lat": 1, "lng": 2}], "edges": [{"from": "a", "to": "b", "geometry": [[1, 2], [3, 4]], "difficulty": "unknown"}]}), encoding="utf-8")
    nodes, edges = documents.read_map(spark, str(tmp_path / "m.json"))
    assert [(r.id, r.lat) for r in nodes.collect()] == [("a", 1.0)]
    assert [(r.src, r.dst, r.difficulty, r.geometry) for r in edges.collect()] == [("a", "b", "unknown", [[1.0, 2.0], [3.0, 4.0]])]
    documents.write_json(nodes, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert json.loads(documents.as_json(nodes).first().json)["id"] == "a"


def test_extract(spark):
    node = lambda i, n: ("node", i, 49.2 + i / 100, 20.0, None, {}, n)
    rows = [node(i, i) for i in (1, 2, 3, 4)]
    rows += [("way", 10, None, None, [1, 2, 3], {"highway": "path", "sac_scale": "mountain_hiking", "name": "W10"}, 10), ("way", 11, None, None, [3, 2, 4, 99], {"highway": "track"}, 11)]
    rows += [("way", 12, None, None, [1, 4], {"highway": "path", "access": "private"}, 12), ("way", 13, None, None, [1, 3], {"access": "private", "sac_scale": "hiking"}, 13)]
    data = spark.createDataFrame(rows, schemas.OSM + ", ord BIGINT")
    assert sorted(r.id for r in osm.selected(data).filter("type = 'way'").collect()) == [10, 11, 13]
    nodes, edges = osm.full_map(data.filter("id < 12 or type = 'node'"))
    assert [(r.src, r.dst, r.difficulty) for r in edges.orderBy("ord").collect()] == [("node/1", "node/2", 2), ("node/2", "node/3", 2), ("node/2", "node/4", 1)]
    assert [r.id for r in nodes.orderBy("id").collect()] == ["node/1", "node/2", "node/3", "node/4"]
    features = spark.createDataFrame([("node", 5, [(49.21, 20.0)], {"natural": "peak", "tourism": "viewpoint", "name": "Top"}, 0), ("node", 6, [(49.3, 20.0)], {"natural": "peak"}, 1)], "type string, id bigint, positions array<struct<lat:double,lng:double>>, tags map<string,string>, ord bigint")
    found = osm.points_of_interest(features, nodes).collect()
    assert [(r.id, r.name, r.type, r.nearest_routing_node_id, r.distance_to_trail_m) for r in found] == [("node/5", "Top", "peak", "node/1", 0)]


def test_search(spark):
    rows = [("1", "Świnica", "peak", 0), ("2", "Łomnica", "peak", 1), ("1", "Sucha", "pass", 2), ("3", "Luka", "gate", 3), ("4", "Małołączniak", "peak", 4)]
    points = spark.createDataFrame(rows, "id string, name string, type string, ord bigint")
    assert [r.name for r in search.sorted_points(points).collect()] == ["Luka", "Łomnica", "Małołączniak", "Sucha"]
    assert search.suggestions(points, "malol").count() == 0
    assert [r.name for r in search.suggestions(points, " MAŁOŁ ").collect()] == ["Małołączniak"]
    assert search.suggestions(points, "  ").count() == 0


def test_store(spark):
    users = spark.createDataFrame([(7, "a@x")], "id bigint, email string")
    batch = spark.createDataFrame([(0, "a@x"), (1, "b@x"), (2, "b@x"), (3, "c@x")], "ord bigint, email string")
    assert sorted((r.ord, r.ok) for r in store.admitted(users, batch).collect()) == [(0, False), (1, True), (2, False), (3, True)]
    assert sorted((r.id, r.email) for r in store.insert_users(users, batch).collect()) == [(8, "b@x"), (9, "c@x")]
    log = spark.createDataFrame([(7, 180, "pro", "easy", 1), (7, None, None, "fast", 2)], "user_id bigint, height_cm int, experience_level string, route_preference string, updated_at int")
    assert [tuple(r) for r in store.profiles_of(users, log).collect()] == [(7, None, "", "fast")]
    once = store.latest(log, "user_id", "updated_at")
    assert store.latest(once, "user_id", "updated_at").collect() == once.collect()
    assert store.favourite_rows(spark.createDataFrame([(["ż", "b"],)], "path array<string>")).first().path == '["ż","b"]'


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"id": i, "user_id": i % 2, "at": f"2024-01-0{i}T00:00:00"}) for i in (1, 2, 3)))
    stream = changes.read_changes(spark, str(tmp_path / "in"), "id bigint, user_id bigint, at timestamp")
    query = changes.append_stream(changes.once_only(stream, "id", "at"), "stream_log", str(tmp_path / "ck"), "user_id", "at")
    query.awaitTermination(60)
    assert sorted((r.user_id, r.id) for r in spark.table("stream_log").collect()) == [(0, 2), (1, 3)]
    counts = changes.counts_by_window(stream.withColumn("kind", F.lit("x")), "at", "kind")
    assert counts.isStreaming


def test_map_job(spark, tmp_path):
    """From an extract to the written map and the points linked to it, by document and by lines."""
    node = lambda i, **tags: {"type": "node", "id": i, "lat": 49.2 + i / 100, "lon": 20.0, "tags": tags}
    elements = [node(1, ele="900"), node(2, name=""), node(3, name="C"), {"type": "way", "id": 9, "nodes": [1, 2, 3, 7], "tags": {"highway": "path"}}, {"type": "way", "id": 8, "nodes": [3, 1], "tags": {"highway": "road"}}]
    (tmp_path / "e.json").write_text(json.dumps({"version": 0.6, "elements": elements}))
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, elements)))
    (tmp_path / "p.json").write_text(json.dumps({"nodes": [{"id": "q", "name": "Q", "lat": 49.2301, "lng": 20.0, "nearest_routing_node_id": "old"}]}))
    for name, lines in (("e.json", False), ("e.jsonl", True)):
        out = tmp_path / f"out-{lines}"
        nodes, edges = osm.build_map(spark, str(tmp_path / name), str(out / "map"), str(tmp_path / "p.json"), str(out / "points"), lines)
        assert [(r.id, r.name, r.elevation) for r in nodes.orderBy("id").collect()] == [("node/1", "Punkt 1", 0.0), ("node/2", "", 0.0), ("node/3", "C", 0.0)]
        assert [(r.src, r.dst, r.distance_km, r.time_min) for r in edges.orderBy("src").collect()] == [("node/1", "node/2", 1.1119, 16.68), ("node/2", "node/3", 1.1119, 16.68)]
        assert [(r.nearest_routing_node_id, r.distance_to_trail_m) for r in spark.read.json(str(out / "points")).collect()] == [("node/3", 11)]


def test_tables(spark):
    for _ in range(2):
        documents.create_tables(spark)
    documents.append(spark.sql("SELECT 1L AS user_id, 180 AS height_cm, '' AS experience_level, 'easy' AS route_preference, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS updated_at"), "user_profiles")
    documents.create_tables(spark)
    assert spark.table("user_profiles").count() == 1
    assert {"user_id", "path", "criterion"} <= set(spark.table("favorite_routes").columns)
