"""SQL of the operators that SQL can express, in the dialect of the checking engine and by other means than the operators'."""

from __future__ import annotations

import string

#: The 256-entry table of CRC-32, from its polynomial.
CRC_TABLE = """crc AS (SELECT list(c ORDER BY i) AS crc_table FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)))"""


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text, with ``crc_table`` in scope."""
    code = f"list_transform(range(1, strlen({text}) + 1), lambda k: CAST(concat('0x', substr(hex(encode({text})), 2 * k - 1, 2)) AS BIGINT))"
    step = "xor(crc_table[CAST(xor(a, b) & 255 AS INTEGER) + 1], a >> 8)"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {code}), lambda a, b: {step}), 4294967295)"


def _classes(least: int = 24, powers: int = 3, longest: int = 1 << 24) -> str:
    rows, low = [], 1
    while low < longest:
        k = min(max(least - q, (powers - 1) * q) for q in range(low, max(low, least) + 1))
        rows.append(f"({low}, {k})")
        low = k + 1
    return ", ".join(rows)


PERIODIC_RUNS = rf"""WITH {CRC_TABLE},
split AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, coalesce(CAST(doc_id AS VARCHAR), '') AS id FROM documents),
hashed AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM (SELECT doc_id, w, {crc32('id')} AS h FROM split, crc)),
planted AS (SELECT doc_id, n, w, h, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM hashed),
texts AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS ws FROM planted),
classes(low, k) AS (VALUES {_classes()}),
shortest AS (SELECT doc_id, list_transform(range(n - 15), lambda i: md5(array_to_string(ws[i + 1:i + 16], ' '))) AS gs FROM texts WHERE n >= 24),
candidates AS (SELECT texts.* FROM texts JOIN shortest USING (doc_id) WHERE len(list_distinct(gs)) < len(gs)),
grams AS (SELECT doc_id, low, k, unnest(gs) AS gram, generate_subscripts(gs, 1) - 1 AS i FROM (
  SELECT doc_id, low, k, list_transform(range(n - k + 1), lambda i: md5(array_to_string(ws[i + 1:i + k], ' '))) AS gs FROM candidates JOIN classes ON low * 3 <= n)),
seeds AS (SELECT doc_id, low, k, i, lag FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id, k, gram ORDER BY i) - i AS lag FROM grams) WHERE lag BETWEEN low AND k),
runs AS (SELECT doc_id, min(i) AS start, max(i) + k + lag - min(i) AS length, lag AS period
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, k, lag ORDER BY i) AS island FROM seeds) GROUP BY doc_id, k, lag, island HAVING length >= greatest(24, 3 * lag)),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed,
  list({{'start': start, 'length': length, 'period': period}} ORDER BY CAST(length AS DOUBLE) / period DESC, start, period)[1] AS best FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM (
    SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM texts SEMI JOIN listed USING (doc_id)) x
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.period AND x.i < r.start + r.length) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, best.length * 1000 // best.period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, array_to_string(ws, ' '))) AS collapsed_sha256
FROM texts t LEFT JOIN listed ON t.doc_id = listed.doc_id LEFT JOIN kept ON t.doc_id = kept.doc_id"""

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
_WIDE = "".join(map(chr, range(0xC0, 0x100)))
#: 64 signs of one byte each for the 64 wide letters, as the engine's edit distance counts bytes.
_NARROW = _UPPER + string.digits + "!#$%&()*+,-./:;<=>?@[]^_{|}~"[:28]

SPELLING_VARIANTS = rf"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS c FROM (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents) WHERE length(run) >= 6 GROUP BY 1, 2),
hashed AS (SELECT run, c, {crc32('key')} AS h FROM (SELECT *, concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run) AS key FROM runs), crc),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
  SELECT c, CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
coded AS (SELECT word, n, length(word) AS size, translate(word, '{_WIDE}', '{_NARROW}') AS code FROM words),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM coded a JOIN (SELECT *, unnest([size - 1, size, size + 1]) AS match FROM coded) b ON a.size = b.match
  WHERE a.word <> b.word AND levenshtein(a.code, b.code) = 1),
best AS (SELECT word, count(*) AS n_near, list({{'form': other, 'form_n': other_n}} ORDER BY other_n DESC, other)[1] AS best FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.form_n >= 5 * w.n THEN best.form END AS form, CASE WHEN best.form_n >= 5 * w.n THEN best.form_n END AS form_n
  FROM words w LEFT JOIN best ON w.word = best.word),
chain(word, reached, depth) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON f.word = c.reached WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(reached, depth) AS root FROM chain GROUP BY word) r ON f.word = r.word"""


_WORDS = rf"coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

DECONTAMINATE = rf"""WITH
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, size, unnest(list_transform(range(len(w) - size + 1), lambda i: array_to_string(w[i + 1:i + size], ' '))) AS gram
  FROM (SELECT *, least(len(w), 10) AS size FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT r, size, unnest(gs) AS gram, generate_subscripts(gs, 1) - 1 AS i FROM (
  SELECT r, size, list_transform(range(len(w) - size + 1), lambda i: array_to_string(w[i + 1:i + size], ' ')) AS gs
  FROM docs JOIN (SELECT DISTINCT size FROM windows) ON len(w) >= size)),
hits AS (SELECT DISTINCT r, grams.size, i, item FROM grams JOIN windows ON grams.size = windows.size AND grams.gram = windows.gram),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, size, i FROM hits)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered ON docs.r = covered.r LEFT JOIN found ON docs.r = found.r"""
