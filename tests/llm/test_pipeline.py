"""The pipeline against plain versions of its stages, and every query of the subpackage on the smallest tables."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline
from ridgeline.llm import byte_bpe, decontaminate, pii
from ridgeline.llm.queries import ORACLES, QUERIES

from . import brute

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "pii_surrogates", "byte_level_bpe"]
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns
    first = {r.doc_id: r.text for r in kept.collect()}
    assert not any(brute.statistics(t)[5] for t in first.values())
    single = corpus_pipeline.near_duplicates(spark, kept, SF)
    second = {r.doc_id: r.text for r in single.collect()}
    assert sorted(second) == sorted(i for i, n, c in brute.near_duplicates(sorted(first.items()), 5, 80) if n == 0 or i == c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    third = {i: second[i] for i, *_, bad in brute.contamination(sorted(second.items()), items) if not bad}
    assert sorted(r.doc_id for r in corpus_pipeline.decontamination(spark, single, SF).collect()) == sorted(third)


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names and empty tables, stage by stage."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    base, item, long = prose(200), prose(12), prose(25_000)
    near = base.split()
    near[100] = "other"
    texts = [None, "", "  ", "few words", base, base, " ".join(near), long, long + " end", prose(60) + " " + item, prose(90) + " a.b@corp.com Mr Roe", prose(90) + " a.b@corp.com Mr Roe", prose(50)]
    rows = [(i, t, ("en", None)[i % 2], ("s", None, "t")[i % 3], None if i % 4 == 0 else 5, i, "x", 1.5, "y") for i, t in enumerate(texts)]
    rows += [rows[6], rows[12], (None, base, None, None, None, 1, "x", None, None), (None, prose(70), "en", "s", 1, 2, None, 2.0, "z"), (12, prose(80), "en", "s", 1, 3, None, 2.0, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, k1 int, term string, distance double, surrogate string").repartition(4)
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out, stays = docs, list(rows)
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        out = stage(spark, out, str(tmp_path))
        assert empty.columns == out.columns
        assert empty.count() == 0
        found[name] = out.collect()
        if name != "byte_level_bpe":
            assert out.columns == docs.columns
            rows_ = found[name] if name != "quality_rules" else [r for r in stays if not brute.statistics(r[1])[5]]  # few rows: a long text is an outlier
            out = spark.createDataFrame(rows_, docs.schema).repartition(3)
    fit = [repr(r) for r in stays if not brute.statistics(r[1])[5]]
    assert sorted(repr(tuple(r)) for r in found["quality_rules"] if len(r.text) < 10_000) == sorted(r for r in fit if len(r) < 10_000)
    assert {repr(tuple(r)) for r in found["quality_rules"]} <= set(fit)
    kept = [(r.doc_id, r.text) for r in found["near_duplicates"]]
    assert sorted(map(repr, kept)) == sorted(repr((rows[i][0], rows[i][1])) for i in (4, 7, 9, 10, 11, 12, 16, 17))
    clean = [x for x in kept if x[0] != 9]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in found["decontamination"]))) == sorted(map(repr, clean))
    masked = {repr(r.doc_id) + r.text[:20]: r.text for r in found["pii_surrogates"]}
    for i, t in clean:
        new = masked[repr(i) + t[:20]]
        assert (new == t) == ("corp.com" not in t)
        assert "corp.com" not in new
    path, pattern = byte_bpe.vocabulary()
    want = sorted(repr((r.doc_id, len(byte_bpe._encoder(path, pattern).encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest())) for r in found["pii_surrogates"])
    assert sorted(repr((r.doc_id, r.n_tokens, r.decoded_sha256)) for r in found["byte_level_bpe"]) == want


def test_run(spark):
    path, pattern = byte_bpe.vocabulary()
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in pii.replaced(docs, pii.secret_key(spark)).collect()}
    assert 0 < len(out) < docs.count()
    encode = byte_bpe._encoder(path, pattern).encode_ordinary
    for i, r in list(out.items())[::7]:
        ids = encode(texts[i])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert not decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet"), "doc_id").filter("contaminated").join(spark.createDataFrame([(i,) for i in out], "doc_id bigint"), "doc_id").count()


_URL_RULES = """
SELECT page_id, host, path, CASE WHEN host = 'www.example.com' OR host LIKE '%.www.example.com' THEN CASE WHEN path LIKE '/en/%' THEN 'www.example.com/en/' WHEN path LIKE '/%' THEN 'com/' END
  WHEN host = 'example.com' OR host LIKE '%.example.com' THEN CASE WHEN path LIKE '/en/%' THEN 'example.com/en/' WHEN path LIKE '/%' THEN 'com/' END
  WHEN host = 'com' OR host LIKE '%.com' THEN CASE WHEN path LIKE '/%' THEN 'com/' END
  WHEN host = 'net' OR host LIKE '%.net' THEN CASE WHEN path LIKE '/es/%' THEN 'net/es/' WHEN path LIKE '/fr/%' THEN 'net/fr/' END END AS rule
FROM (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
"""
_BASE = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, list_slice(w, i, i + 4) AS g FROM w WHERE len(w) >= 5),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(w) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(w) AS base_failed
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
"""


@pytest.mark.parametrize(("name", "sql", "table"), [("op5_url_filters", _URL_RULES, "pages"), ("op9_quality_rules", _BASE, "documents")])
def test_columns_that_sql_can_express(spark, name, sql, table):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(sql)
    got = QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
