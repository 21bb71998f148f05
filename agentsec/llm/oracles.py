"""The same results in SQL, for the operators that SQL can express."""

from . import quality


def _crc_table() -> list[int]:
    """CRC-32 of each byte, from its polynomial."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    return table


_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "".join(map(chr, range(65, 91)))


def _jump_cte(name: str, shards: int) -> str:
    return f"""{name} AS (SELECT key, max(b) AS shard FROM (
    WITH RECURSIVE r(key, k, b, j) AS (
      SELECT key, key::HUGEINT, -1::BIGINT, 0::BIGINT FROM (SELECT DISTINCT key FROM d)
      UNION ALL
      SELECT key, k2, j, CAST(floor((j + 1) * (CAST(2147483648 AS DOUBLE) / CAST(k2 // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
      FROM (SELECT key, (k * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT AS k2, j FROM r WHERE j < {shards}))
    SELECT key, b FROM r) GROUP BY key)"""


OP2 = f"""WITH b AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, length(h) // 2 AS bytes, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
  lambda crc, x: xor(crc >> 8, ({_crc_table()}::BIGINT[])[CAST(xor(crc & 255, x) + 1 AS BIGINT)])), 4294967295::BIGINT) AS crc FROM b),
d AS (SELECT doc_id, bytes + 1 AS size, crc AS text_crc32, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM c),
{_jump_cte("s16", 16)},
{_jump_cte("s17", 17)}
SELECT d.doc_id, d.size, d.text_crc32, 'key' AS law, CAST(s16.shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY s16.shard ORDER BY d.key % greatest(1, (SELECT (count(*) + 4095) // 4096 FROM documents)), d.doc_id, d.text_crc32, d.size) - 1 AS slot, CAST(s17.shard AS INTEGER) AS grown_shard FROM d JOIN s16 USING (key) JOIN s17 USING (key)"""

OP4 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
cut AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS p FROM (SELECT g.doc_id, g.i FROM g JOIN f ON g.g = f.g WHERE f.first < g.doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS t FROM words LEFT JOIN cut ON cut.doc_id = words.doc_id AND cut.p = words.p WHERE cut.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

OP8 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id"""

_TO_LOWER = f"translate({{}}, '{_UPPER}', '{_UPPER.lower()}')"
OP11 = f"""WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
o AS (SELECT id, {_TO_LOWER.format("run")} AS run, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT run, n, hex(encode(id || ':' || run)) AS h FROM o WHERE length(run) >= 5),
c AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
  lambda crc, x: xor(crc >> 8, ({_crc_table()}::BIGINT[])[CAST(xor(crc & 255, x) + 1 AS BIGINT)])), 4294967295::BIGINT) AS h FROM b),
e AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, n FROM c),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
k AS (SELECT word, n, i, substr(word, 1, CAST(i - 1 AS BIGINT)) AS head, substr(word, CAST(i + 1 AS BIGINT)) AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT k.word, v.word, v.n FROM k JOIN v ON v.word = k.head || k.tail
  UNION SELECT v.word, k.word, k.n FROM k JOIN v ON v.word = k.head || k.tail),
g AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM p GROUP BY word),
f AS (SELECT p.word, min(p.near) AS form, g.top AS form_n FROM p JOIN g ON g.word = p.word AND p.near_n = g.top JOIN v ON v.word = p.word WHERE g.top >= 2 * v.n GROUP BY ALL),
w(word, node, step) AS (SELECT word, word, 0 FROM v UNION ALL SELECT w.word, f.form, w.step + 1 FROM w JOIN f ON f.word = w.node)
SELECT v.word, f.form, t.root, v.n, coalesce(g.n_near, 0) AS n_near, f.form_n FROM v LEFT JOIN g ON g.word = v.word LEFT JOIN f ON f.word = v.word JOIN (SELECT word, max_by(node, step) AS root FROM w GROUP BY word) t ON t.word = v.word"""

_RULES = ", ".join(f"CASE WHEN {condition} THEN {1 << k} ELSE 0 END AS r{k}" for k, (_, condition) in enumerate(quality.RULES))
_SUM = " + ".join(f"r{k}" for k in range(len(quality.RULES)))
_SOLE = " ".join(f"WHEN failed & {quality.mask_of(quality.POLICIES[quality.CURRENT])} = {quality.BITS[name]} THEN '{name}'" for name in quality.POLICIES[quality.CURRENT])
OP13 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
again AS (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest(range(0, 8)) AS j FROM g JOIN again USING (r, g)) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, length(regexp_replace(t, '\\P{{L}}+', '', 'g')) AS n_letters FROM w LEFT JOIN covered USING (r)),
b AS (SELECT *, CAST({_SUM} AS BIGINT) AS failed FROM (SELECT *, {_RULES} FROM m))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {quality.mask_of(quality.POLICIES[1])} <> 0 AS base_failed, failed & {quality.mask_of(quality.POLICIES[quality.CURRENT])} = 0 AS kept, n_lines, n_letters, failed,
  {quality.CURRENT} AS policy, CASE {_SOLE} END AS sole_rule FROM b"""
