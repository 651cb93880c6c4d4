"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({lowered("text")}, '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({lowered("text")}, '{ALNUM}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

# DuckDB has no base32: 20 bits, so 5 hex and 4 base32 digits, at a time
OP2 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (
  SELECT hex, array_to_string(list_transform(range(32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || hex[(i // 4) * 5 + 1:(i // 4) * 5 + 5])::INTEGER >> (5 * (3 - i % 4))) & 31)]), '') AS digest,
    min(page_id) AS first_id
  FROM p GROUP BY hex)
SELECT page_id, url, CAST(strlen(body) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN g USING (hex)
"""

OP7 = f"""
WITH r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
best AS (
  SELECT page_id, u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
    arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY ALL)
SELECT u.page_id, u.host, u.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM u LEFT JOIN best USING (page_id)
"""



def _crc_entry(byte: int) -> int:
    """Entry of the table of CRC-32 (reflected polynomial EDB88320)."""
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


# DuckDB has no crc32: the bytes are folded by the usual table. Words one edit apart share a text with
# one letter masked (replaced), or one is the other with a letter left out (inserted or deleted).
OP12 = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents)
  GROUP BY ALL),
crc AS (SELECT [{", ".join(str(_crc_entry(b)) for b in range(256))}]::BIGINT[] AS t),
bytes AS (
  SELECT run, k, flatten(list_transform(string_split(doc || ':' || run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b FROM runs),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, b::BIGINT[]), lambda h, x:
    xor(h >> 8, t[(xor(h, x) & 255) + 1]))) AS h FROM bytes, crc),
cut AS (
  SELECT k, CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
    ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS (SELECT DISTINCT word, left(word, i - 1) || substr(word, i + 1) AS other FROM places),
masked AS (SELECT word, left(word, i - 1) || '*' || substr(word, i + 1) AS mask FROM places),
near AS (
  SELECT a.word, b.word AS other FROM masked a JOIN masked b USING (mask) WHERE a.word <> b.word
  UNION SELECT word, other FROM less WHERE other IN (SELECT word FROM words)
  UNION SELECT other, word FROM less WHERE other IN (SELECT word FROM words)),
best AS (
  SELECT near.word, CAST(count(*) AS BIGINT) AS n_near, min((-w.n, other)) AS top
  FROM near JOIN words w ON w.word = near.other GROUP BY near.word),
forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top[1] >= 10 * n THEN top[2] END AS form,
    CASE WHEN -top[1] >= 10 * n THEN -top[1] END AS form_n
  FROM words LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, root FROM walk JOIN forms ON forms.word = root WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""

# scores are rounded before they are ranked, so that equal texts tie whatever the order of their sums
OP10 = rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all({lowered("text")}, '[^\x20\x09-\x0D]+')) AS word FROM documents),
tf AS (SELECT doc_id, word, count(*) AS c FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
corpus AS (SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM words) AS n_words),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
scored AS (
  SELECT q.doc_id AS query_id, tf.doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5))
    * tf.c * 2.2 / (tf.c + 1.2 * (0.25 + 0.75 * n / (n_words / n_docs)))), 9) AS score
  FROM tf q JOIN tf USING (word) JOIN df USING (word) JOIN lengths ON lengths.doc_id = tf.doc_id, corpus
  WHERE q.doc_id % 100 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10
"""

ORACLE: dict[str, str] = {
    "op1_decontamination": OP1,
    "op2_warc": OP2,
    "op7_url_rules": OP7,
    "op10_search": OP10,
    "op12_spelling": OP12,
}
