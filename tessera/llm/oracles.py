"""DuckDB SQL with the rows of the registered queries, where SQL can express them."""

SPACE = r"[\x20\x09-\x0D]+"

OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY s) AS first FROM w),
c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM m WHERE first < doc_id),
k AS (SELECT *, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run),
g AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, list(b ORDER BY a) AS bs, list(a ORDER BY a) AS starts FROM r GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(list_zip(list_prepend(0, bs), list_append(starts, n)),
         lambda z: substr(h, 2 * z[1] + 1, 2 * (z[2] - z[1]))), '') END)) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def _found(kind: str, at: int, pattern: str, value: str, keep: str) -> str:
    """Rows (doc_id, source, repository, kind, at, start, stop, value) of one kind."""
    return f"""
    SELECT doc_id, source, lang, '{kind}' AS kind, {at} AS ord, start, start + length(whole) AS stop, value FROM (
      SELECT doc_id, source, lang, whole[i] AS whole, value[i] AS value,
             CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start
      FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
        SELECT doc_id, source, lang, string_split_regex(text, '{pattern}') AS pieces, regexp_extract_all(text, '{pattern}') AS whole, {value} AS value
        FROM d WHERE regexp_matches(text, '{pattern}')))) WHERE {keep}"""


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))[""'']?\x20*[:=]\x20*[""'']?([A-Za-z0-9+/_.=-]+)""".replace('""', '"')
_GENERIC = r"[A-Za-z0-9+/_-]{20,}={0,2}"
OP3 = f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
c AS ({_found("assign", 0, _ASSIGN, f"regexp_extract_all(text, '{_ASSIGN}', 2)", "length(value) >= 6")}
 UNION ALL {_found("access", 1, "AKIA[A-Z0-9]+", "regexp_extract_all(text, 'AKIA[A-Z0-9]+')", "length(value) >= 20")}
 UNION ALL {_found("hex", 2, "[0-9a-f]{24,}", "regexp_extract_all(text, '[0-9a-f]{24,}')", "true")}
 UNION ALL {_found("generic", 3, _GENERIC, f"regexp_extract_all(text, '{_GENERIC}')", "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')")}),
o AS (SELECT value, count(DISTINCT source) AS n_owners FROM c GROUP BY value),
j AS (SELECT c.*, n_owners <= 2 AS live FROM c JOIN o USING (value)),
k AS (SELECT * FROM j WHERE ord < 3 OR (live AND NOT EXISTS (SELECT 1 FROM j b WHERE b.doc_id = j.doc_id AND b.ord < 3 AND b.start < j.stop AND j.start < b.stop))),
a AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans,
      count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN a USING (doc_id)
"""

OP6 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
h AS (SELECT doc_id, i, array_to_string(ws[i:i+7], chr(32)) AS gram FROM g),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM h) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM twice, range(8) t(k)) GROUP BY doc_id),
lines AS (SELECT doc_id, source, regexp_replace(regexp_replace(lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))), '[0-9]+', '0', 'g'), ' +', ' ', 'g') AS line,
          len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM (SELECT doc_id, source, unnest(ls) AS l FROM w)),
freq AS (SELECT source, line FROM lines GROUP BY source, line HAVING count(DISTINCT doc_id) > 100),
gone AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM lines SEMI JOIN freq USING (source, line) GROUP BY doc_id),
r AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
      length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
      coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_frequent_words FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_frequent_words > 0 AND (n_words - n_frequent_words < 20 OR n_words - n_frequent_words < 0.2 * n_words)) AS kept FROM r
"""

OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], chr(32)) AS sh FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.doc_id = d.doc_id
"""

OP9 = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(role || text) + length(regexp_replace(role || text, '[^\\x1b<\\[]', '', 'g')) AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(escaped + 10 + 9 + 5 + CASE WHEN role = 'assistant' THEN 11 ELSE 0 END) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""

OP10 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS digest FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY digest, octet_length(payload)) AS first FROM p),
b AS (SELECT *, replace(replace(CAST(CAST(unhex(digest) AS BIT) AS VARCHAR), '0b', ''), ' ', '') AS bits FROM r)
SELECT page_id, octet_length(payload) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER)
         + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER)
         + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""



def _then(x: str, cost: str, letter: str) -> str:
    """A path (nine digits of cost, then its letters) with one more letter."""
    return f"lpad(CAST(CAST(left({x}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || '{letter}'"


def _inserted(x0: str, x1: str, x2: str, x3: str) -> str:
    """The least paths to the states after s?, u and a, when rows may be inserted."""
    u = f"least({x2}, {_then(x0, '3', 'I')}, {_then(x1, '3', 'I')}, {_then(x3, '3', 'I')})"
    return f"{x0} AS x0, {x1} AS x1, {u} AS x2, least({x3}, {_then('x2', '3', 'I')}) AS x3"


def _kept(x: str, role: str) -> str:
    return f"CASE WHEN lower(c) = '{role}' THEN {_then(x, 'extra', 'K')} END"


def _turned(x: str) -> str:
    return f"CASE WHEN c <> 'd' THEN {_then(x, '3 + extra', 'R')} END"


OP11 = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
fates AS (SELECT conv_id, turn, xor(4294967295, list_reduce(list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT)),
  lambda h, b: list_reduce(range(8), lambda v, z: xor(v >> 1, (v & 1) * 3988292384), xor(h, b)), CAST(4294967295 AS BIGINT))) % 20 AS fate FROM ids),
d AS (SELECT c.conv_id, c.turn, CASE WHEN fate = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
        CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
        unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM conversations c JOIN fates f ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.turn IS NOT DISTINCT FROM f.turn),
s AS (SELECT *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM d),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS pos,
        CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM s),
rws AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM q),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
        list(CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN initial NOT IN ('s', 'u', 'a') THEN CASE WHEN fault = 'truncated' THEN 'X' ELSE 'x' END
             WHEN fault = 'truncated' THEN upper(initial) ELSE initial END ORDER BY pos) AS codes FROM rws GROUP BY conv_id),
steps AS (
  SELECT conv_id, 0 AS i, codes, '000000000' AS x0, CAST(NULL AS VARCHAR) AS x1, '000000003I' AS x2, '000000006II' AS x3 FROM stats
  UNION ALL
  SELECT conv_id, i, codes, {_inserted("y0", "y1", "y2", "y3")} FROM (
    SELECT conv_id, i + 1 AS i, codes, {_then("x0", "4", "D")} AS y0, least({_then("x1", "4", "D")}, {_kept("x0", "s")}) AS y1,
      least({_then("x2", "4", "D")}, {_kept("x0", "u")}, {_kept("x1", "u")}, {_kept("x3", "u")}, {_turned("x0")}, {_turned("x1")}, {_turned("x3")}) AS y2,
      least({_then("x3", "4", "D")}, {_kept("x2", "a")}, {_turned("x2")}) AS y3
    FROM (SELECT *, codes[i + 1] AS c, CASE WHEN codes[i + 1] IN ('S', 'U', 'A', 'X') THEN 3 ELSE 0 END AS extra FROM steps WHERE i < len(codes)))),
best AS (SELECT conv_id, least(x0, x3) AS x FROM steps WHERE i = len(codes)),
audits AS (SELECT conv_id, CAST(left(x, 9) AS BIGINT) AS cost, substr(x, 10) AS audit FROM best),
letters AS (SELECT conv_id, letter, j, CASE WHEN letter <> 'I' THEN sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) END AS pos
            FROM (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS j, unnest(string_split(audit, '')) AS letter FROM audits WHERE audit <> '')),
outs AS (SELECT l.conv_id, l.letter, l.j, w.role, coalesce(w.text, '') AS text, coalesce(sum(CASE WHEN l.letter = 'K' AND w.initial = 's' THEN 0 ELSE 1 END) OVER (PARTITION BY l.conv_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
         FROM letters l LEFT JOIN rws w ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.pos = w.pos WHERE l.letter <> 'D'),
repaired AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN before % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS body FROM outs GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN stats s ON i.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN audits a ON i.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN repaired r ON i.conv_id IS NOT DISTINCT FROM r.conv_id
"""

ORACLES = {"op1_suffix_dedup": OP1, "op2_exact_topk": OP2, "op3_secrets": OP3, "op6_quality": OP6, "op8_minhash": OP8, "op9_chat": OP9, "op10_warc": OP10, "op11_dialogue_repair": OP11}
