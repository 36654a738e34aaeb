"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""
WITH iw AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, len(g) AS n, array_to_string(g, ' ') AS g FROM (SELECT item, list_slice(w, i, i + 9) AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0))),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, runs.n, i FROM runs JOIN win ON runs.n = win.n AND runs.g = win.g),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hit GROUP BY doc_id),
wt AS (SELECT g, ws, unnest(ws) AS term, generate_subscripts(ws, 1) AS off FROM (SELECT DISTINCT g, string_split(g, ' ') AS ws FROM win)),
pos AS (SELECT doc_id, w, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM dw),
tc AS (SELECT term, count(*) AS n FROM pos WHERE term IN (SELECT term FROM wt) GROUP BY term),
rarest AS (SELECT g, ws, term FROM (SELECT g, any_value(ws) AS ws, arg_min(term, n * 100 + off) AS term, count(*) AS k FROM wt JOIN tc USING (term) GROUP BY g) WHERE k = len(ws)),
around AS (SELECT doc_id, g, ws, list_slice(w, greatest(p - 9, 1), p + 9) AS ar FROM pos JOIN rarest USING (term)),
near AS (SELECT doc_id, count(DISTINCT g) AS n_near FROM around WHERE len(list_filter(ws, lambda x: len(list_filter(ar, lambda y: y = x)) < len(list_filter(ws, lambda y: y = x)))) = 0 GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0)::BIGINT AS n_near
FROM dw LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE dw AS (SELECT doc_id, {_SPACED} AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM dw WHERE len(w) > 0))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least_, doc_id)) AS component_id
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least_ FROM reach GROUP BY a) USING (doc_id)
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = f"""
WITH dw AS MATERIALIZED (SELECT doc_id, {_TERMS} AS w FROM documents),
size AS (SELECT count(*)::BIGINT AS nn, sum(len(w))::BIGINT AS ll FROM dw WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS MATERIALIZED (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM dw) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
wt AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY term, nn),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN wt USING (term), size GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

# Checksums byte by byte; the code points of runs are below 256, so a run's UTF-8 bytes are one or two a code point.
VARIANTS = rf"""
WITH RECURSIVE bits(i, k, c) AS (SELECT range, 0, range::BIGINT FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tbl AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS MATERIALIZED (SELECT doc_id, w, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
coded AS (SELECT doc_id, w, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS b FROM runs),
hashed AS (SELECT w, n, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM coded, tbl),
slips AS (SELECT CASE WHEN h % 97 = 0 THEN w[: h % len(w)] || w[h % len(w) + 2 :] ELSE w END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slips WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS MATERIALIZED (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS less FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words)),
longer AS MATERIALIZED (SELECT DISTINCT c.word AS a, c.n AS an, w.word AS b, w.n AS bn FROM cuts c JOIN words w ON c.less = w.word),
near AS (SELECT x.word AS word, y.word AS near, y.n AS near_n FROM cuts x JOIN cuts y ON x.i = y.i AND x.less = y.less AND x.word <> y.word UNION ALL SELECT a, b, bn FROM longer UNION ALL SELECT b, a, an FROM longer),
best AS (SELECT word, count(*)::BIGINT AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON chain.root = forms.word WHERE forms.form IS NOT NULL)
SELECT word, n, n_near, form, form_n, chain.root AS root FROM forms JOIN chain USING (word) WHERE chain.root IN (SELECT word FROM forms WHERE form IS NULL)
"""

VECTORS = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a) USING (vec_id)
"""

ORACLES: dict[str, str] = {"op1_benchmark_decontamination": DECONTAMINATION, "op2_ngram_jaccard_join": JACCARD, "op11_spelling_variants": VARIANTS, "op12_ranked_lexical_search": RANKED, "op13_embedding_near_dedup": VECTORS}
