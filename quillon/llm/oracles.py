"""Queries of the training-data operators in SQL for DuckDB, by definition and without their methods."""

from __future__ import annotations

from .decontaminate import UPPER

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
_TOKENS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _windows(k: str, source: str) -> str:
    return f"SELECT doc_id, i, array_to_string(w[i + 1:i + {k}], ' ') AS g FROM {source}, unnest(range(0, greatest(len(w) - {k} + 1, 0))) AS t(i)"


def repetition(window: int = 5, min_words: int = 8, max_repeat: int = 60) -> str:
    """Words in windows found twice or more in their text, for two window lengths; a longer repeat by windows one longer."""

    def covered(k: int) -> str:
        twice = f"SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM ({_windows(str(k), 'd')})) WHERE n > 1"
        return f"SELECT DISTINCT doc_id, i + j AS p FROM ({twice}), unnest(range(0, {k})) AS u(j)"

    return rf"""
WITH d AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
short_ AS (SELECT doc_id, count(*) AS n FROM ({covered(window)}) GROUP BY doc_id),
long_ AS (SELECT c.doc_id, sum(length(d.w[c.p + 1])) AS n FROM ({covered(min_words)}) c JOIN d USING (doc_id) GROUP BY c.doc_id),
longest AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY doc_id, g) AS n FROM ({_windows(str(max_repeat + 1), 'd')})) WHERE n > 1),
all_ AS (
  SELECT b.*, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(s.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(r.n, 0) AS BIGINT) AS repeat_chars, x.doc_id IS NOT NULL AS too_long
  FROM base b LEFT JOIN lines l USING (doc_id) LEFT JOIN short_ s USING (doc_id) LEFT JOIN long_ r USING (doc_id) LEFT JOIN longest x USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM all_)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_chars, base_failed,
       NOT base_failed AND NOT too_long AND repeat_chars <= 0.25 * word_chars AS kept FROM judged
"""


CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_TOKENS} AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i + 1:i + 10], ' ') AS g FROM b, unnest(range(0, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM grams),
spots AS (SELECT doc_id, i, k, array_to_string(w[i + 1:i + k], ' ') AS g FROM d, sizes, unnest(range(0, greatest(len(w) - k + 1, 0))) AS t(i)),
found AS (SELECT doc_id, i, k, item_id FROM spots JOIN grams USING (k, g)),
hits AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM found, unnest(range(0, k)) AS t(j) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id),
post AS (SELECT doc_id, p, w[p + 1] AS term FROM d, unnest(range(0, len(w))) AS t(p)),
tf AS (SELECT term, count(*) AS df FROM post GROUP BY term),
one AS (SELECT row_number() OVER () AS item, * FROM (SELECT DISTINCT coalesce(item_id, '') AS item_id, w FROM b WHERE len(w) > 0)),
spots3 AS (SELECT item, item_id, len(w) AS size, q, w[q + 1] AS term FROM one, unnest(range(0, len(w))) AS t(q)),
wins AS (SELECT item, item_id, s, q, term, coalesce(df, 0) AS df FROM spots3 LEFT JOIN tf USING (term), unnest(range(greatest(q - 9, 0), least(q, greatest(size - 10, 0)) + 1)) AS t(s)),
here AS (SELECT *, first(term) OVER (PARTITION BY item, s ORDER BY df, term, q) AS rarest FROM wins WHERE df > 0),
second AS (SELECT *, row_number() OVER (PARTITION BY item, s ORDER BY df, term, q) AS r FROM here WHERE term <> rarest),
anchors AS (
  SELECT DISTINCT item, item_id, term, q FROM (SELECT *, row_number() OVER (PARTITION BY item, s ORDER BY df, term, q) AS r FROM here) WHERE r = 1
  UNION SELECT DISTINCT item, item_id, term, q FROM second WHERE r = 1),
lines AS (SELECT DISTINCT doc_id, item, item_id, p - q AS diag, term FROM post JOIN anchors USING (term)),
close_ AS (SELECT DISTINCT doc_id, item_id FROM (
  SELECT *, lag(diag) OVER o AS before_, lag(term) OVER o AS other FROM lines WINDOW o AS (PARTITION BY doc_id, item ORDER BY diag, term)) WHERE diag - before_ <= 20 AND term <> other),
near_ AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS l FROM close_ GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s.l, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated, CAST(coalesce(c.n, 0) AS BIGINT) AS n_near, sha256(coalesce(c.l, '')) AS near_sha256
FROM d LEFT JOIN hits h USING (doc_id) LEFT JOIN ids s USING (doc_id) LEFT JOIN near_ c USING (doc_id)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 2], ' ') AS g FROM d, unnest(range(0, greatest(len(w) - 1, 1))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS v, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.v),
k AS (SELECT v, min(m) AS m FROM r GROUP BY v)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(k.m, doc_id) AS component_id, coalesce(k.m, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.v = doc_id
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM ({_windows("20", "d")})) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM later, unnest(range(0, 20)) AS u(j)),
words AS (SELECT doc_id, p, w[p + 1] AS word FROM d, unnest(range(0, len(w))) AS t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words WHERE (doc_id, p) NOT IN (SELECT doc_id, p FROM gone) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


def warc(date: str = "2024-01-01T00:00:00Z") -> str:
    """Derivative records of pages: digests, name-based ids and records put together from their parts.

    For pages whose tags are whole and that have no other entities than those named here.
    """
    blocks = "p|div|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|aside|blockquote|pre|title|form|figure|dd|dt"
    drop = "|".join(rf"<{t}\b.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "noscript", "template"))
    text = rf"regexp_replace(html, '(?si)<!--.*?(?:-->|\z)|{drop}', ' ', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '(?i)<(?:/?(?:{blocks})|br)\b[^>]*>', chr(10), 'g'), '<[a-zA-Z/!?][^>]*>', '', 'g')"
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{char}')"
    text = rf"trim(regexp_replace(regexp_replace({text}, '[ \t\r\f\v\x{{A0}}]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), chr(10) || ' ')"

    def digest(x: str) -> str:
        return f"'sha1:' || list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST('0b' || substr(CAST(unhex(sha1({x})) AS BIT)::VARCHAR, CAST(5 * i + 1 AS BIGINT), 5) AS INTEGER), 1)), 'string_agg', '')"

    def uuid(h: str) -> str:
        variant = f"substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr({h}, 17, 1)), 1)"
        return f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'"

    named = lambda x: f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({x}))"
    return rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS nl FROM pages),
q AS (SELECT *, octet_length(encode(html)) AS size, 'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || octet_length(encode(html)) || nl || nl || html AS whole,
  {named(f"coalesce(CAST(page_id AS VARCHAR), 'None') || '|' || url || '|response|{date}'")} AS h FROM p),
r AS (SELECT *, {uuid('h')} AS source_id, {digest('html')} AS payload_digest, {digest('whole')} AS whole_digest FROM q),
m AS (SELECT *, 'metadata' AS type, 'application/warc-fields' AS kind, 'source-status: HTTP/1.1 200 OK' || nl || 'source-header-content-type: text/html; charset=utf-8' || nl || 'source-header-content-length: ' || size || nl
    || 'source-payload-digest: ' || payload_digest || nl || 'source-block-digest: ' || whole_digest || nl || 'source-content-length: ' || octet_length(encode(whole)) || nl
    || 'source-payload-length: ' || size || nl || 'source-payload-digest-verified: true' || nl AS block FROM r
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', {text} FROM r),
d AS (SELECT *, {named("source_id || '|' || type")} AS g, {digest('block')} AS block_digest, CAST(octet_length(encode(block)) AS BIGINT) AS content_length FROM m),
e AS (SELECT *, {uuid('g')} AS record_id FROM d)
SELECT page_id, source_id, record_id, type, url AS target_uri, '{date}' AS date, source_id AS refers_to, block_digest, payload_digest AS source_payload_digest, content_length,
  sha256('WARC/1.1' || nl || 'WARC-Type: ' || type || nl || 'WARC-Record-ID: ' || record_id || nl || 'WARC-Target-URI: ' || url || nl || 'WARC-Date: {date}' || nl || 'WARC-Refers-To: ' || source_id || nl
    || 'WARC-Refers-To-Target-URI: ' || url || nl || 'WARC-Refers-To-Date: {date}' || nl || 'Content-Type: ' || kind || nl || 'WARC-Block-Digest: ' || block_digest || nl
    || 'Content-Length: ' || content_length || nl || nl || block || nl || nl) AS record_sha256
FROM e
"""


#: What stands between the tags of the one article that the given pages have.
MAIN_TEXT = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|\z)', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(?:p|h1|h2|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""
