"""SQL that must give the same rows as operators 11 to 13."""

# CRC-32 of a list of bytes, as list functions: the table of 256 entries comes out of its rule
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc32(data: str) -> str:
    """Of a text whose code points are below 256 (UTF-8), with table crc in scope."""
    code = "unicode(ch)"
    parts = f"CASE WHEN {code} < 128 THEN [{code}] ELSE [192 | ({code} >> 6), 128 | ({code} & 63)] END"
    octets = f"flatten(list_transform(string_split({data}, ''), lambda ch: {parts}))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


_UPPER = "".join(map(chr, range(65, 91)))

OP11 = rf"""
WITH RECURSIVE {_CRC_TABLE},
doc AS (SELECT row_number() OVER () AS r, coalesce(CAST(doc_id AS VARCHAR), '') AS id,
  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[A-Za-zÀ-ÿ]+') AS runs FROM documents),
own AS (SELECT id, run, count(*) AS n FROM (SELECT r, id, unnest(runs) AS run FROM doc) GROUP BY r, id, run),
marked AS (SELECT run, n, {_crc32("id || ':' || run")} AS h FROM own, crc),
edited AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n
  FROM marked),
vocab AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, left(word, i - 1) AS l, substr(word, i + 1) AS r FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
gone AS (SELECT c.word AS a, v.word AS b FROM cut c JOIN vocab v ON v.word = c.l || c.r),
pair AS (
  SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.l = y.l AND x.r = y.r AND x.i = y.i AND x.word <> y.word
  UNION SELECT a, b FROM gone UNION SELECT b, a FROM gone),
near AS (SELECT a AS word, b, v.n AS b_n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) AS k
  FROM pair JOIN vocab v ON v.word = b),
judged AS (
  SELECT vocab.word, vocab.n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 2 * vocab.n THEN b END AS form,
    CASE WHEN b_n >= 2 * vocab.n THEN b_n END AS form_n
  FROM vocab LEFT JOIN near ON near.word = vocab.word AND k = 1),
chain AS (
  SELECT word, word AS at FROM judged
  UNION ALL SELECT chain.word, judged.form FROM chain JOIN judged ON judged.word = chain.at WHERE judged.form IS NOT NULL)
SELECT judged.word, judged.n, judged.n_near, judged.form, judged.form_n, chain.at AS root
FROM judged JOIN chain ON chain.word = judged.word JOIN judged last ON last.word = chain.at AND last.form IS NULL"""

OP12 = rf"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
part AS (
  SELECT DISTINCT r, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM doc WHERE len(w) > 0)),
sized AS (SELECT r, count(*) AS n FROM part GROUP BY r),
met AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM part a JOIN part b USING (s) WHERE a.r < b.r GROUP BY ALL),
link AS (
  SELECT a, b FROM met JOIN sized x ON x.r = a JOIN sized y ON y.r = b WHERE 100 * met.n >= 90 * (x.n + y.n - met.n)),
reached AS (
  SELECT r AS a, r AS b FROM doc
  UNION SELECT reached.a, l.b FROM reached JOIN (SELECT a, b FROM link UNION ALL SELECT b, a FROM link) l ON l.a = reached.b)
SELECT d.doc_id, coalesce(any_value(sized.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM reached JOIN doc d ON d.r = reached.a JOIN doc o ON o.r = reached.b LEFT JOIN sized ON sized.r = reached.a
GROUP BY reached.a, d.doc_id"""

OP13 = rf"""
WITH {_CRC_TABLE},
turn AS (
  SELECT conv_id, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, list(t ORDER BY pos) AS own FROM turn GROUP BY conv_id),
headed AS (SELECT *, CAST({_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS BIGINT) AS h FROM conv, crc),
rebuilt AS (
  SELECT c.conv_id, list_concat(CASE WHEN h > 0 THEN coalesce(b.own[1:h], []) ELSE [] END, c.own[h + 1:]) AS seq
  FROM headed c LEFT JOIN conv b ON b.conv_id = c.conv_id - c.conv_id % 100),
step AS (SELECT conv_id, len(seq) AS n, d, seq[1:d] AS p FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM step GROUP BY d, p),
child AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
worth AS (
  SELECT node.d, node.p, n_convs, coalesce(n_children, 0) AS n_children,
    CASE WHEN node.d > 0 THEN (n_convs - 1) * length(node.p[node.d].text) ELSE 0 END AS value
  FROM node LEFT JOIN child ON child.d = node.d AND child.p = node.p),
below AS (
  SELECT k AS d, p[1:k] AS p, sum(value) AS saved, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM worth) GROUP BY ALL)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n_convs, worth.n_children, below.n_leaves,
  CAST(below.saved AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node JOIN worth ON worth.d = node.d AND worth.p = node.p JOIN below ON below.d = node.d AND below.p = node.p
LEFT JOIN node up ON up.d = node.d - 1 AND up.p = node.p[1:node.d - 1]"""
