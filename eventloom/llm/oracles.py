"""DuckDB SQL for the operators that SQL can express, by a plain path of its own."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Full sets by equal joins of shingles, links by counting, components by reaching the least id.
MINHASH = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN w ELSE [w[i], w[i + 1]] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
names AS (SELECT s, row_number() OVER () AS k FROM (SELECT s FROM s GROUP BY 1 HAVING count(*) > 1)),
k AS (SELECT doc_id, k FROM s JOIN names USING (s)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM k a JOIN k b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, ways.b FROM reach r JOIN ways ON r.b = ways.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY 1) USING (doc_id)
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows of the items looked up among all windows of the same length of the documents.
DECONTAMINATE = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM wins),
places AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs CROSS JOIN sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, i, p.size, item FROM places p JOIN wins USING (size, win)),
hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS spot FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_HEX = "0123456789abcdef"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Forty hexadecimal digits are 160 bits, which are 32 letters of five bits.
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h FROM p),
top AS (SELECT h, max(page_id) AS top FROM d GROUP BY 1),
bits AS (SELECT page_id, string_agg(bin_part, '' ORDER BY i) AS b FROM (
    SELECT page_id, i, lpad(bin(strpos('{_HEX}', h[i]) - 1), 4, '0') AS bin_part FROM (SELECT page_id, h, unnest(range(1, 41)) AS i FROM d)) GROUP BY 1),
digests AS (SELECT page_id, string_agg(letter, '' ORDER BY i) AS digest FROM (
    SELECT page_id, i, '{_BASE32}'[1 + list_sum(list_transform(range(1, 6), lambda j: CAST(b[5 * i + j] AS INTEGER) * CAST(pow(2, 5 - j) AS INTEGER)))::INTEGER] AS letter
    FROM (SELECT page_id, b, unnest(range(0, 32)) AS i FROM bits)) GROUP BY 1)
SELECT page_id, payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM d JOIN top USING (h) JOIN digests USING (page_id)
"""

#: Every phrase of one to four words counted, cuts by equal joins of their parts.
PHRASES = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS size),
g AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM w CROSS JOIN sizes WHERE len(w) >= size) GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE size = 1 GROUP BY 1),
c AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS w FROM g WHERE size > 1 AND f >= 30),
longer AS (SELECT DISTINCT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, f FROM (SELECT lang, w, f, size, k, unnest(range(1, size - k + 2)) AS i FROM c CROSS JOIN (SELECT unnest([2, 3]) AS k) WHERE k < size)),
kept AS (SELECT c.* FROM c LEFT JOIN (SELECT lang, phrase, max(f) AS most FROM longer GROUP BY 1, 2) m USING (lang, phrase) WHERE most IS NULL OR 100 * most::HUGEINT < 80 * c.f::HUGEINT),
cuts AS (SELECT lang, phrase, f, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 :], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
scored AS (SELECT x.lang, x.phrase, x.f AS a, k, p.f AS l, q.f AS r, (2000000::HUGEINT * x.f) // (p.f::HUGEINT + q.f) AS score FROM cuts x JOIN g p ON p.lang = x.lang AND p.phrase = x.first JOIN g q ON q.lang = x.lang AND q.phrase = x.rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score FROM best)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

_CRC = [0] * 256
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c

#: Near words by patterns with one place open: equal patterns differ by one replacement, a pattern without its place is a deletion.
SPELLING = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY 1, 2 HAVING length(run) >= 6),
b AS (SELECT doc_id, run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substring(x, 2 * i - 1, 2))::BIGINT)), lambda c, v: xor(({_CRC}::BIGINT[])[(xor(c, v) & 255) + 1], c >> 8))) AS h FROM b),
made AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
open AS (SELECT word, i, length(word) AS size, substring(word, 1, i - 1) AS head, substring(word, i + 1) AS tail FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word AS a, b.word AS b FROM open a JOIN open b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail WHERE a.word <> b.word
  UNION SELECT o.word, v.word FROM open o JOIN v ON v.word = o.head || o.tail
  UNION SELECT v.word, o.word FROM open o JOIN v ON v.word = o.head || o.tail),
told AS (SELECT near.a AS word, near.b AS other, x.n AS n, y.n AS m FROM near JOIN v x ON x.word = near.a JOIN v y ON y.word = near.b),
best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, m, n FROM told QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) = 1),
forms AS (SELECT word, n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM best),
way AS (SELECT word, word AS spot, 0 AS step FROM v UNION ALL SELECT way.word, f.form, step + 1 FROM way JOIN forms f ON f.word = way.spot WHERE f.form IS NOT NULL)
SELECT v.word, form, ends.spot AS root, v.n, coalesce(n_near, 0) AS n_near, form_n
FROM v LEFT JOIN forms USING (word) JOIN (SELECT word, spot FROM way QUALIFY row_number() OVER (PARTITION BY word ORDER BY step DESC) = 1) ends ON ends.word = v.word
"""

ORACLES = {"op5_warc_salvage": WARC, "op6_minhash_join": MINHASH, "op7_fm_decontaminate": DECONTAMINATE, "op11_partenum_spelling": SPELLING, "op13_bwt_phrases": PHRASES}
