"""SQL of the queries that SQL can express, for DuckDB."""

#: crc(bytes as hexadecimal text), as a list of table entries and a fold over the bytes.
_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
    xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS entries)"""


def _crc(text: str) -> str:
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: A word of the runs of a text, with the slips; near words share a word with one letter less, or lack the same letter.
SPELLING = f"""WITH {_TABLE}, runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc("doc_id || ':' || run")} AS h FROM counted, crc_table),
slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
less AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.rest),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY 1),
firsts AS (SELECT b.word, b.n_near, b.most, min(other) AS other FROM best b JOIN near x ON x.word = b.word AND x.other_n = b.most GROUP BY ALL),
held AS (
  SELECT w.word, w.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.most >= 10 * w.n THEN f.other END AS form, CASE WHEN f.most >= 10 * w.n THEN f.most END AS form_n
  FROM words w LEFT JOIN firsts f USING (word)),
"""
SPELLING = SPELLING.replace("WITH crc", "WITH RECURSIVE crc", 1) + """walk AS (
  SELECT word, word AS root, 0 AS step FROM held
  UNION ALL SELECT walk.word, held.form, step + 1 FROM walk JOIN held ON held.word = walk.root WHERE held.form IS NOT NULL)
SELECT held.word, form, arg_max(root, step) AS root, n, n_near, form_n FROM held JOIN walk USING (word) GROUP BY ALL"""

#: Trees level by level; a node's siblings are the others of its run.
MANIFEST = f"""WITH RECURSIVE {_TABLE}, leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("text")} AS leaf,
    CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf(_LOWER)} END AS tampered
  FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
up AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, level, pos // 8, n),
tops AS (SELECT tree, level, digest FROM up WHERE n = 1),
over AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, digest FROM tops
  UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY level, pos // 8, n),
ranked AS (SELECT tree, level AS depth, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank FROM tops),
below AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM up a JOIN up b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
above AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM over a JOIN over b ON a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
path AS (
  SELECT p.tree, p.pos, b.level AS k, b.l, b.r FROM placed p JOIN below b ON b.tree = p.tree AND b.pos = p.pos // CAST(8 ** b.level AS BIGINT)
  UNION ALL SELECT p.tree, p.pos, 1000 + a.level, a.l, a.r
  FROM placed p JOIN ranked r USING (tree) JOIN above a ON a.pos = r.rank // CAST(8 ** a.level AS BIGINT)),
proofs AS (SELECT tree, pos, list(k ORDER BY k) AS ks, list(l ORDER BY k) AS ls, list(r ORDER BY k) AS rs, string_agg(l || r, '' ORDER BY k) AS every FROM path GROUP BY 1, 2),
folded AS (
  SELECT p.tree, p.pos, coalesce(p.tampered, p.leaf) AS node, 1 AS i FROM placed p
  UNION ALL SELECT f.tree, f.pos, sha256(q.ls[f.i] || f.node || q.rs[f.i]), f.i + 1 FROM folded f JOIN proofs q USING (tree, pos) WHERE f.i <= len(q.ks)),
ends AS (SELECT tree, pos, arg_max(node, i) AS folded_root FROM folded GROUP BY 1, 2),
root AS (SELECT digest AS root FROM over WHERE n = 1)
SELECT p.doc_id, p.leaf, r.subroot, root.root, sha256(coalesce(q.every, '')) AS proof_sha256, e.folded_root, e.folded_root = root.root AS verified
FROM placed p JOIN ranked r USING (tree) JOIN ends e USING (tree, pos) CROSS JOIN root LEFT JOIN proofs q USING (tree, pos)"""

ORACLE = {"op11_spelling": SPELLING, "op13_manifest": MANIFEST}
