"""DuckDB statements for the text queries that SQL can express."""

from __future__ import annotations

from shelfwise.llm.quality_rules import BASE, RULES, Rule, _stop_forms

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

def _classes(width: int, further: str = "") -> str:
    """Classes of documents whose shingle sets reach 85 %."""
    window = " || ' ' || ".join(f"ws[i + {k}]" if k else "ws[i]" for k in range(width))
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE
      WHEN len(ws) >= {width} THEN [{window} FOR i IN range(1, len(ws) - {width - 2})]
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common c JOIN sizes p ON p.doc_id = c.x JOIN sizes q ON q.doc_id = c.y
  WHERE 100 * c.n >= 85 * (p.n + q.n - c.n)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM words UNION SELECT r.a, e.y FROM reach r JOIN edges e ON r.b = e.x),
tops AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, t.component_id{further}
FROM words w LEFT JOIN sizes s USING (doc_id) JOIN tops t ON t.a = w.doc_id
"""


_LINES = r"""
WITH pages AS (SELECT row_number() OVER () AS row, * FROM documents),
seen AS (SELECT DISTINCT row, source, unnest(string_split(text, chr(10))) AS line FROM pages WHERE source IS NOT NULL),
often AS (SELECT source, line, count(*) AS n FROM seen WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL HAVING count(*) >= 3),
totals AS (SELECT source, count(*) AS pages FROM pages WHERE source IS NOT NULL GROUP BY source),
plain AS (SELECT source, list(line) AS ls FROM often JOIN totals USING (source) WHERE n > pages * 0.03 GROUP BY source),
cut AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS lines,
    [x FOR x IN string_split(text, chr(10)) IF NOT list_contains(coalesce(ls, []), x)] AS kept
  FROM pages LEFT JOIN plain USING (source)
)
SELECT doc_id, source, coalesce(len(lines), 0)::BIGINT AS lines_total,
  coalesce(len(lines) - len(kept), 0)::BIGINT AS lines_removed, array_to_string(kept, chr(10)) AS text
FROM cut
"""

_ARCHIVES = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
top AS (SELECT html, max(page_id) AS keeper FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN keeper IS DISTINCT FROM page_id AND keeper IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to, url
FROM p LEFT JOIN top USING (html)
"""

_BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE first < doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER o <= 50 THEN 0 ELSE 1 END AS new FROM hits WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
islands AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM islands GROUP BY doc_id, island),
gaps AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
pieces AS (
  SELECT g.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id
), ends AS (SELECT doc_id, max(b) AS last, sum(b - a) AS removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN pieces USING (doc_id) LEFT JOIN ends USING (doc_id)
"""

_PHRASES = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE first < doc_id),
covered AS (SELECT DISTINCT doc_id, i + k AS i FROM hits, range(0, 13) t(k)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

# crc32 bit by bit; runs as islands of equal words q apart, the smallest q of an interval being its period
_RUNS = rf"""
WITH src AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS ws,
    list_reduce([4294967295::BIGINT] || flatten([[(ascii(c) >> k) & 1 FOR k IN range(0, 8)] FOR c IN string_split(doc_id::VARCHAR, '')]),
      lambda a, b: xor(a >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END)) AS crc
  FROM documents),
hashed AS (SELECT row, doc_id, ws, len(ws) AS n, xor(crc, 4294967295) AS h FROM src),
tails AS (SELECT *, (h // 10) % greatest(n, 1) AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM hashed),
d AS (SELECT row, doc_id, n, CASE WHEN n > 0 AND h % 10 = 0
    THEN [ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(0, n)] ELSE ws END AS ws FROM tails),
words AS (SELECT row, n, unnest(ws) AS word, unnest(range(0, n)) AS i FROM d),
alike AS (SELECT x.row, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.row = y.row AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT row, q, min(i) AS s, count(*) + q AS len
  FROM (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM alike) GROUP BY row, q, island),
runs AS (SELECT row, s, len, min(q) AS q FROM islands WHERE len >= greatest(6, 4 * q) GROUP BY row, s, len),
told AS (SELECT row, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    min(struct_pack(a := -len, b := s, c := q)) AS best FROM runs GROUP BY row),
covered AS (SELECT DISTINCT row, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN covered USING (row, i) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.b::BIGINT AS start, (-best.a)::BIGINT AS length, best.c::BIGINT AS period,
  (1000 * -best.a // best.c)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (row) LEFT JOIN kept USING (row)
"""

_LEXICAL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_LEXICAL}')"

_RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS ts FROM documents),
stats AS (SELECT count(*) FILTER (WHERE len(ts) > 0)::BIGINT AS N, sum(len(ts))::BIGINT AS L FROM d),
postings AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(ts) AS term FROM d) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * N + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, stats GROUP BY term, N),
asked AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS ts FROM benchmark),
wanted AS (SELECT DISTINCT item, item_id, unnest(ts) AS term FROM asked),
scores AS (
  SELECT item, item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ts) * N) // L))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN postings USING (term) JOIN d USING (row), stats GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def _broken(rule: Rule) -> str:
    divisor = f"greatest({rule.below}, 1)" if rule.below else "1"
    parts = []
    if rule.least is not None:
        parts.append(f"100 * {rule.top} < {round(rule.least * 100)} * {divisor}")
    if rule.most is not None:
        parts.append(f"100 * {rule.top} > {round(rule.most * 100)} * {divisor}")
    return "(" + " OR ".join(parts) + ")"


def _rules() -> str:
    stop = ", ".join("'" + w + "'" for w in _stop_forms())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
grams AS (SELECT row, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT row, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
twice AS (SELECT row, g FROM grams GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM grams JOIN twice USING (row, g), range(0, 3) t(k) GROUP BY row),
stops AS (SELECT [{stop}] AS forms),
counts AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines,
    coalesce(n, 0) AS n_repeat_words,
    len([w FOR w IN ws IF list_contains(forms, w)]) AS n_stop_words,
    len([w FOR w IN ws IF length(w) > 1 AND upper(w) = w AND lower(w) <> w]) AS n_shouted
  FROM d LEFT JOIN covered USING (row), stops
), flat AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM counts)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  {" OR ".join(map(_broken, BASE))} AS base_failed, NOT ({" OR ".join(map(_broken, (*BASE, *RULES)))}) AS kept
FROM flat
"""


SQL = {
    "op1_minhash_near_dedup": _classes(3, ", t.component_id = w.doc_id AS kept"),
    "op2_line_dedup": _LINES,
    "op5_warc": _ARCHIVES,
    "op6_suffix_array_dedup": _BYTES,
    "op9_substring_dedup": _PHRASES,
    "op10_quality_rules": _rules(),
    "op11_jaccard_join": _classes(4),
    "op12_ranked_search": _RANKED,
    "op13_periodic_runs": _RUNS,
}
