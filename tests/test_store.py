"""Merges that break off, batches that come again, tables that grow columns, a relational source, suggestions for many queries."""

from __future__ import annotations

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import search, store
from ridgeline.sources import documents
from ridgeline.streaming import changes

PROFILE = "user_id bigint, height_cm int, updated_at bigint"


def content(spark, path):
    return {r.user_id: (r.height_cm, r.updated_at) for r in store.merged_rows(spark, path).collect()}


def test_merge(spark, tmp_path):
    """Against a dict, with batches in any order and again; untouched buckets keep their files."""
    path, rng, want = str(tmp_path / "profiles"), random.Random(1), {}
    batches = [[(rng.randint(0, 40), rng.randint(150, 200), 100 * b + k) for k in range(30)] for b in range(4)]
    for b in (1, 0, 3, 1, 2):
        store.merge(spark.createDataFrame(batches[b], PROFILE).repartition(3), path, "user_id", "updated_at", buckets=8)
        for user, height, at in batches[b]:
            if user not in want or at > want[user][1]:
                want[user] = (height, at)
        assert content(spark, path) == want
    files = lambda: {f: f.stat().st_mtime_ns for f in tmp_path.glob("profiles/bucket=*/*.parquet")}
    before = files()
    store.merge(spark.createDataFrame([(1, 1, 10_000)], PROFILE), path, "user_id", "updated_at", buckets=8)
    assert 0 < len(set(before.items()) - set(files().items())) <= 2 and len(set(before.items()) & set(files().items())) > 3
    store.merge(spark.createDataFrame([], PROFILE), path, "user_id", "updated_at", buckets=8)
    assert content(spark, path) == want | {1: (1, 10_000)}
    empty = str(tmp_path / "none")
    store.merge(spark.createDataFrame([], PROFILE), empty, "user_id", "updated_at")
    assert not (tmp_path / "none").exists()
    store.merge(spark.createDataFrame([(None, 5, 1), (None, 6, 2)], PROFILE), empty, "user_id", "updated_at")
    assert content(spark, empty) == {None: (6, 2)}


def test_merge_that_breaks_off(spark, tmp_path, monkeypatch):
    """While the new buckets take their places, even with one already gone: the next merge finishes it. Before they are complete: nothing has happened."""
    path = str(tmp_path / "profiles")
    rows = [(i, 170, i) for i in range(30)]
    store.merge(spark.createDataFrame(rows, PROFILE), path, "user_id", "updated_at", buckets=4)
    want = content(spark, path)
    overwrite = store._overwrite

    def broken(frame, target):
        gone = next((tmp_path / "profiles").glob("bucket=*"))
        gone.rename(tmp_path / "lost")
        raise RuntimeError("the driver dies")

    monkeypatch.setattr(store, "_overwrite", broken)
    with pytest.raises(RuntimeError):
        store.merge(spark.createDataFrame([(i, 180, 100) for i in range(30)], PROFILE), path, "user_id", "updated_at", buckets=4)
    monkeypatch.setattr(store, "_overwrite", overwrite)
    store.recover(spark, path)
    assert content(spark, path) == {i: (180, 100) for i in want}
    # a broken-off write of the new buckets has no mark of success
    (tmp_path / "profiles_pending/bucket=0").mkdir(parents=True)
    (tmp_path / "profiles_pending/bucket=0/part.parquet").write_bytes(b"half")
    store.merge(spark.createDataFrame([(3, 190, 200)], PROFILE), path, "user_id", "updated_at", buckets=4)
    assert content(spark, path)[3] == (190, 200) and len(content(spark, path)) == 30


def test_inserts_that_come_again(spark):
    table = f"users_{uuid.uuid4().hex}"
    batches = {0: [(0, "a"), (1, "b"), (2, "a")], 1: [(0, "b"), (1, "c")], 2: [(0, "a")], 5: [(7, "d"), (3, "e")]}
    frame = lambda b: spark.createDataFrame(batches[b], "ord bigint, email string")
    for b in (0, 0, 1, 2, 5, 1, 0, 2):
        store.insert_users_once(frame(b), table, b)
    got = sorted((r.id, r.email, r.batch) for r in spark.table(table).collect())
    assert got == [(1, "a", 0), (2, "b", 0), ((1 << 40) + 1, "c", 1), ((5 << 40) + 1, "e", 5), ((5 << 40) + 2, "d", 5)]
    # a batch whose rows are gone when it comes again leaves none
    documents.append_once(frame(5).limit(0).select(F.lit(1).cast("bigint").alias("id"), "email", "ord"), table, 5)
    assert spark.table(table).count() == 3
    spark.sql(f"DROP TABLE {table}")


def test_streams_that_start_again(spark, tmp_path):
    """A stream without its checkpoint sees all files again: the log takes batches in their own places, the merged table stays."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"user_id": i % 3, "height_cm": 100 + i, "updated_at": i}) for i in range(9)))
    table, path = f"log_{uuid.uuid4().hex}", str(tmp_path / "merged")
    for again in range(2):
        stream = changes.read_changes(spark, str(tmp_path / "in"), PROFILE)
        changes.append_stream(stream, table, str(tmp_path / f"a{again}"), "user_id", "updated_at").awaitTermination(60)
        changes.merge_stream(stream, path, str(tmp_path / f"m{again}"), "user_id", "updated_at").awaitTermination(60)
    want = {0: (106, 6), 1: (107, 7), 2: (108, 8)}
    assert {r.user_id: (r.height_cm, r.updated_at) for r in spark.table(table).collect()} == want and spark.table(table).count() == 3
    assert content(spark, path) == want
    spark.sql(f"DROP TABLE {table}")


def test_tables_that_grow(spark):
    """An old table gets the new columns, its rows nulls there; twice changes nothing; another type is refused."""
    name = f"old_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (id BIGINT, note STRING) USING parquet")
    spark.sql(f"INSERT INTO {name} VALUES (1, 'x')")
    assert documents.add_columns(spark, name, "ID BIGINT, name STRING, path STRING") == ["name", "path"]
    assert documents.add_columns(spark, name, "id BIGINT, name STRING, path STRING") == []
    spark.sql(f"INSERT INTO {name} (id, note, name, path) VALUES (2, 'y', 'n', 'p')")
    assert sorted(tuple(r) for r in spark.table(name).collect()) == [(1, "x", None, None), (2, "y", "n", "p")]
    with pytest.raises(ValueError, match="is bigint, not string"):
        documents.add_columns(spark, name, "id STRING")
    spark.sql(f"DROP TABLE {name}")
    spark.sql("DROP TABLE IF EXISTS favorite_routes")
    spark.sql("CREATE TABLE favorite_routes (id BIGINT, user_id BIGINT, route_name STRING, created_at TIMESTAMP_NTZ) USING parquet")
    documents.create_tables(spark)
    documents.create_tables(spark)
    assert {"start_point_name", "end_point_name", "distance_km", "time_min", "elevation_gain_m", "criterion", "path"} <= set(spark.table("favorite_routes").columns)


def test_relational_source(spark, tmp_path):
    """Columns and filters go to the database; a column with bounds splits the read."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(100).selectExpr("id", "id % 7 AS user_id", "concat('r', id) AS route_name").write.jdbc(url, "favorite_routes")
    rows = documents.read_jdbc(spark, url, "favorite_routes")
    mine = store.favourites_of(rows.withColumn("created_at", F.lit(1)), 3)
    assert [r.id for r in mine.collect()] == list(range(94, 0, -7))[: len(range(3, 100, 7))]
    plan = rows.filter("user_id = 3").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,3)" in plan.replace(" ", "") and "route_name" not in plan
    parted = documents.read_jdbc(spark, url, "favorite_routes", partitionColumn="id", lowerBound="0", upperBound="100", numPartitions="4")
    assert parted.rdd.getNumPartitions() == 4 and parted.count() == 100


def test_suggestions_for_many(spark):
    """The same as one query after the other; short, long, absent, empty and equal texts."""
    rng = random.Random(4)
    names = ["Świnica", "Łomnica", "Kościelec", "Mały Kościelec", "Rysy", "Żółta Turnia", "żleb", None, ""]
    rows = [(str(i % 80), None if rng.random() < 0.05 else f"{rng.choice(names)} {rng.choice('abcxyz')}{i % 13}", rng.choice(("peak", "pass", None)), i) for i in range(120)]
    points = spark.createDataFrame(rows, "id string, name string, type string, ord bigint").repartition(3)
    queries = ["kosc", "koś", " MAŁY k", "ł", "y", "zz", "", "  ", None, "1", "12", "peak", "kościelec x", "nic", "nica ", "nica", "kośc"]
    got = {}
    for r in search.suggestions_for(points, spark.createDataFrame(list(enumerate(queries)), "q_id int, query string")).collect():
        got.setdefault(r.q_id, []).append((r.place, r.id))
    for i, q in enumerate(queries):
        want = [r.id for r in search.suggestions(points, q).collect()] if q else []
        assert [x for _, x in sorted(got.get(i, []))] == want, q
