"""DuckDB SQL for the operators that SQL can express."""

#: Windows of 200 bytes by their MD5; runs of removed bytes as gaps and islands.
OP2_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT r, unnest(range(0, len(x) // 2 - 199)) AS i FROM d WHERE len(x) >= 400),
named AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM starts JOIN d USING (r)),
again AS (SELECT r, i FROM named QUALIFY count(*) OVER (PARTITION BY h) > 1),
fresh AS (SELECT r, i, CASE WHEN i - lag(i) OVER w <= 200 THEN 0 ELSE 1 END AS n FROM again WINDOW w AS (PARTITION BY r ORDER BY i)),
runs AS (SELECT r, i, sum(n) OVER (PARTITION BY r ORDER BY i) AS run FROM fresh),
spans AS (SELECT r, run, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY r, run),
cuts AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM spans),
whole AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS gone, count(*) AS n, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM cuts JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN whole USING (r)
"""

#: Windows of 35 words by their MD5.
OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
named AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM starts JOIN d USING (r)),
again AS (SELECT r, i FROM named QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT r, i + j AS p FROM again, (SELECT unnest(range(35)) AS j)),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

#: Windows of up to ten item words, looked up by phrase.
OP6_SQL = r"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (SELECT DISTINCT item, len(w[i : i + 9]) AS n, array_to_string(w[i : i + 9], ' ') AS phrase FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
named AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM starts JOIN d USING (r)),
found AS (SELECT r, n, i, item FROM named JOIN windows USING (n, phrase)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hits USING (r) LEFT JOIN names USING (r)
"""

#: Reading the compacted shards back through the manifest gives every document whole.
OP8_SQL = """
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256, TRUE AS listed
FROM documents
"""

#: Every document meets every order: it is removed at the first step whose filter it fails.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS x FROM d),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
fails AS (SELECT r, part, map {
  'A': len(x) < 100, 'B': 100 * len(list_distinct(x)) < 80 * len(x), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
  'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > first, FALSE)} AS f,
  EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND toxic = 1) AS toxic
  FROM w JOIN firsts USING (t)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || g.c || h.c || e.c AS filter_order FROM letters a, letters b, letters g, letters h, letters e WHERE len(list_distinct([a.c, b.c, g.c, h.c, e.c])) = 5),
places AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
gone AS (SELECT part, good, toxic, f, filter_order, coalesce(list_min([i FOR i IN range(1, 6) IF f[substr(filter_order, i, 1)]]), 6) AS gone_at FROM fails, orders),
steps AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS c,
  count(*) FILTER (gone_at > step) AS kept, count(*) FILTER (gone_at = step) AS removed, count(*) FILTER (f[substr(filter_order, step, 1)] AND gone_at < step) AS redundant,
  count(*) FILTER (f[substr(filter_order, step, 1)] AND len([i FOR i IN range(1, 6) IF f[substr(filter_order, i, 1)]]) = 1) AS unique_fails,
  count(*) FILTER (gone_at = step AND good) AS good_lost, count(*) FILTER (gone_at = step AND toxic) AS toxic_lost
  FROM gone JOIN places USING (filter_order) GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM steps
"""

#: Four base32 letters are five hexadecimal digits.
OP13_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS x, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM h
"""

#: All anchors with all rows.
OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
near AS (SELECT r, anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, other) AS place FROM pairs WHERE same QUALIFY place <= 5)
SELECT n.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY n.r, place ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM near n JOIN pairs p ON n.r = p.r AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""
