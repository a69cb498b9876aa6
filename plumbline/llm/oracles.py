"""DuckDB statements of the corpus queries that SQL can express."""

from __future__ import annotations

from plumbline.llm.licenses import BASE, SHARE, SLACK, TEMPLATES

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: lower-cases A-Z only
_ASCII_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format(text=_ASCII_LOWER.format(text="coalesce(text, '')"))} AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), sized AS (SELECT doc_id, len(s) AS n, s FROM sets), flat AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n, any_value(a.n) + any_value(b.n) AS all_n
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM common WHERE 100 * both_n >= 75 * (all_n - both_n)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (
  SELECT a, a FROM sym UNION SELECT sym.b, reach.root FROM reach JOIN sym ON sym.a = reach.node
), comp AS (SELECT node, min(root) AS root FROM reach GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id,
  doc_id = coalesce(root, doc_id) AS kept
FROM sized LEFT JOIN comp ON node = doc_id
"""

SUBSTRING = f"""
WITH words AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
), lows AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM windows JOIN lows USING (h) WHERE doc_id > low
), lists AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY 1)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(js, i)) END, ' ')) AS kept_sha256
FROM words LEFT JOIN lists ON lists.doc_id = words.doc_id
"""

TOP_K = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i])) AS BIGINT) AS score
  FROM rows q JOIN rows x ON x.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""

#: Base32 digit by digit: five hexadecimal digits of the SHA-1 make four.
_BASE32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((part >> {shift}) & 31 AS INTEGER), 1)"
_DIGITS = " || ".join(_BASE32.format(shift=s) for s in (15, 10, 5, 0))
WARC = f"""
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha FROM pages
), parts AS (
  SELECT page_id, i, CAST('0x' || substr(sha, 5 * i + 1, 5) AS BIGINT) AS part FROM (SELECT *, unnest(range(0, 8)) AS i FROM sized)
), digests AS (SELECT page_id, string_agg({_DIGITS}, '' ORDER BY i) AS digest FROM parts GROUP BY page_id),
firsts AS (SELECT sha, min(page_id) AS first FROM sized GROUP BY sha)
SELECT s.page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN s.page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN s.page_id <> first THEN first END AS refers_to
FROM sized s JOIN digests d ON d.page_id = s.page_id JOIN firsts f ON f.sha = s.sha
"""

CHAT = """
WITH turns AS (
  SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|im_', '<|_im_') AS text,
    replace(replace(replace(role, chr(13), ' '), chr(10), ' '), '<|im_', '<|_im_') AS name,
    CAST(floor(coalesce(turn, 0) / 256) AS BIGINT) AS segment FROM conversations
), speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role IS DISTINCT FROM 'system'),
lines AS (
  SELECT t.*, speaker, role IS NOT DISTINCT FROM speaker AS own,
    '<|im_start|>' || CASE WHEN role IS NOT DISTINCT FROM speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE coalesce('user name=' || name, 'user') END || chr(10) AS head,
    text || '<|im_end|>' AS body
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role NULLS FIRST, text
    ROWS UNBOUNDED PRECEDING) - length(body) - 1 AS pos FROM lines
)
SELECT conv_id, speaker, segment, CAST(0 AS BIGINT) AS piece, CAST(min(pos - length(head)) AS BIGINT) AS start, CAST(count(*) AS INTEGER) AS n_messages,
  string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS rendered,
  string_agg(CASE WHEN own THEN '1' ELSE '0' END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS mask,
  coalesce(string_agg(CASE WHEN own THEN CAST(pos AS VARCHAR) || '-' || CAST(pos + length(body) AS VARCHAR) END, ',' ORDER BY turn NULLS FIRST, role NULLS FIRST, text), '') AS spans
FROM placed GROUP BY conv_id, speaker, segment
"""



def _values(rows: list[tuple]) -> str:
    """Rows of strings, numbers and lists of strings as SQL literals."""
    one = lambda x: str(x) if isinstance(x, int) else "['" + "', '".join(x) + "']" if isinstance(x, list) else f"'{x}'"
    return ", ".join("(" + ", ".join(map(one, row)) + ")" for row in rows)


_PHRASES = sorted({*BASE, *[p for t in TEMPLATES for p in t.must]})
LICENSES = rf"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex({_ASCII_LOWER.format(text="coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM words),
phrases AS (SELECT * FROM (VALUES {_values([(p, p.split()) for p in _PHRASES])}) t(phrase, ws)),
base(phrase, label) AS (VALUES {_values(list(BASE.items()))}),
templates AS (SELECT * FROM (VALUES {_values([(k, t.label, t.text.split()) for k, t in enumerate(TEMPLATES)])}) t(k, label, ws)),
must(k, phrase) AS (VALUES {_values([(k, p) for k, t in enumerate(TEMPLATES) for p in t.must])}),
postings AS (SELECT k, unnest(ws) AS word, unnest(range(len(ws))) AS q FROM templates),
vocabulary AS (SELECT DISTINCT word FROM postings UNION SELECT unnest(ws) FROM phrases),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM flat JOIN vocabulary USING (word) GROUP BY 1),
weights AS (
  SELECT word, greatest(1, CAST(round(1000 * ln(1 + (SELECT count(*) FROM documents) / (1 + coalesce(df, 0)))) AS BIGINT)) AS weight
  FROM vocabulary LEFT JOIN df USING (word)
), places AS (
  SELECT f.doc_id, phrase, len(ws) AS size, i FROM flat f JOIN phrases ON ws[1] = word JOIN words d ON d.doc_id = f.doc_id WHERE w[i + 1:i + len(ws)] = ws
), sums AS (SELECT k, sum(weight) AS total, count(*) AS m FROM postings JOIN weights USING (word) GROUP BY 1),
able AS (
  SELECT doc_id, k FROM places JOIN must USING (phrase) GROUP BY 1, 2
  HAVING count(DISTINCT phrase) = (SELECT count(*) FROM must o WHERE o.k = must.k)
), hits AS (
  SELECT DISTINCT doc_id, k, q, i - q - e AS d FROM flat JOIN postings USING (word) JOIN able USING (doc_id, k), (SELECT unnest(range(-{SLACK}, {SLACK} + 1)) AS e)
), aligned AS (
  SELECT doc_id, k, d, sum(weight) AS weighs FROM hits JOIN postings USING (k, q) JOIN weights USING (word) GROUP BY 1, 2, 3
), good AS (
  SELECT doc_id, a.k, d, weighs / total AS share FROM aligned a JOIN sums s ON s.k = a.k
  WHERE 100 * weighs >= {SHARE} * total AND NOT EXISTS (
    SELECT 1 FROM must o WHERE o.k = a.k AND NOT EXISTS (
      SELECT 1 FROM places p WHERE p.doc_id = a.doc_id AND p.phrase = o.phrase AND p.i >= d - {SLACK} AND p.i + p.size <= d + m + {SLACK}))
), own AS (SELECT doc_id, label, share FROM good JOIN templates USING (k)),
found AS (SELECT doc_id, label, i FROM places JOIN base USING (phrase)),
by_base AS (
  SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found GROUP BY 1
), every AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM (SELECT doc_id, label, 1.0::DOUBLE AS share FROM found UNION ALL SELECT doc_id, label, share FROM own) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(e.labels, '') AS labels, CAST(coalesce(e.score, 0) AS DOUBLE) AS score
FROM words d LEFT JOIN by_base b ON b.doc_id = d.doc_id LEFT JOIN every e ON e.doc_id = d.doc_id
"""

#: CRC-32 of an ASCII string, byte by byte with the table of one-byte remainders.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, remainders[1 + (xor(c, x) & 255)])), 4294967295)"
_HALF = "xor(n >> 1, 3988292384 * (n & 1))"


def _step(ops: list[tuple[str, str, str]]) -> str:
    """The cheapest of some edits as a struct (cost, audit); an edit is (state before, cost, letters)."""
    return "list_min([" + ", ".join(f"{{'c': {s}.c + {c}, 'a': {s}.a || '{a}'}}" for s, c, a in ops) + "])"


_FAR = "CASE WHEN {0} THEN {1} ELSE 1000000000 END"
_KEEPS = {x: _FAR.format(f"NOT gone AND role[1] = '{x}'", "late") for x in "sua"}
_STAYS = _FAR.format("NOT gone", "late")
_TO_USER = [(s, f"{c} + {k}", a + b) for s, c, a in (("n", 0, ""), ("s", 0, ""), ("a", 0, ""), ("u", 2, "I")) for k, b in ((_KEEPS["u"], "K"), ("2 + " + _STAYS, "R"))]
_TO_ASSISTANT = [(s, f"{c} + {k}", a + b) for s, c, a in (("u", 0, ""), ("n", 2, "I"), ("s", 2, "I"), ("a", 2, "I")) for k, b in ((_KEEPS["a"], "K"), ("2 + " + _STAYS, "R"))]
REPAIR = rf"""
WITH RECURSIVE bytes AS (SELECT unnest(range(256)) AS b, unnest(range(256)) AS n, 0 AS k UNION ALL SELECT b, {_HALF}, k + 1 FROM bytes WHERE k < 8),
crc AS (SELECT list(n ORDER BY b) AS remainders FROM bytes WHERE k = 8),
marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC.format(text="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations, crc
), hurt AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM marked WHERE k <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM hurt
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$') AS cut FROM numbered
), rows AS (
  SELECT conv_id, i, turn, role, text, CASE WHEN blank THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN cut THEN 'truncated' END AS fault,
    blank OR seen > 1 AS gone, CASE WHEN NOT blank AND seen = 1 AND cut THEN 1 ELSE 0 END AS late,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS past, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS n, {{'c': 1000000000::BIGINT, 'a': ''}} AS s,
    {{'c': 1000000000::BIGINT, 'a': ''}} AS u, {{'c': 1000000000::BIGINT, 'a': ''}} AS a FROM rows
  UNION ALL
  SELECT w.conv_id, i, {_step([("n", "3", "D")])}, {_step([("s", "3", "D"), ("n", _KEEPS["s"], "K")])},
    {_step([("u", "3", "D"), *_TO_USER])}, {_step([("a", "3", "D"), *_TO_ASSISTANT])}
  FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND i = past + 1
), ends AS (
  SELECT conv_id, list_min([n, a, {{'c': u.c + 2, 'a': u.a || 'I'}}, {{'c': s.c + 4, 'a': s.a || 'II'}}]) AS best
  FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY past DESC) = 1
), letters AS (
  SELECT conv_id, best.a AS audit, unnest(string_split(best.a, '')) AS e, unnest(range(1, len(best.a) + 1)) AS j FROM ends WHERE best.a <> ''
), matched AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS o FROM letters
), kept AS (
  SELECT m.conv_id, j, o, CASE WHEN e = 'K' THEN role END AS role, CASE WHEN e = 'I' THEN '' ELSE text END AS text
  FROM matched m JOIN rows r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = greatest(m.i, 1) WHERE e <> 'D'
), lined AS (
  -- after the system row, if any, users and assistants take turns
  SELECT *, coalesce(role, CASE WHEN (o - max(CASE WHEN role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id)) % 2 = 1 THEN 'user' ELSE 'assistant' END) AS name FROM kept
), texts AS (SELECT conv_id, string_agg(name || ':' || text, chr(10) ORDER BY j) AS whole FROM lined GROUP BY 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND coalesce(before, '') || coalesce(role[1], '') NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY 1
), every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT v.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM every v LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM v.conv_id
  LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM v.conv_id
"""

ORACLES: dict[str, str] = {
    "op3_near_duplicates": NEAR,
    "op6_warc": WARC,
    "op7_chat": CHAT,
    "op9_substring_dedup": SUBSTRING,
    "op10_top_k": TOP_K,
    "op11_licenses": LICENSES,
    "op13_conversation_repair": REPAIR,
}
