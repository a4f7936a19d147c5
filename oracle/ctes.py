"""Building blocks of the check statements: common table expressions in DuckDB's SQL."""

from __future__ import annotations

from inkwell.functions import text as t

SITE = "https://blog.example.org"
DOC = "id, type, status, title, slug, url, editor_url, plaintext, tags_csv, published_at, updated_at"


def _dates(n: str) -> str:
    day = f"strftime(DATE '2022-01-01' + CAST(({n} * 37) % 1461 AS INTEGER), '%Y-%m-%d')"
    hour = f"lpad(CAST({n} % 24 AS VARCHAR), 2, '0')"
    return f"{day} || 'T00:00:00.000Z' AS published, {day} || 'T' || {hour} || ':00:00.000Z' AS updated_at"


ARCHIVE = f"""
posts_raw AS (
  SELECT d.doc_id, 'd' || d.doc_id AS id, lang, source, quality, toxic,
    CASE WHEN quality = 0 AND toxic = 0 THEN 'draft' WHEN quality = 0 AND toxic = 1 THEN 'scheduled'
         WHEN quality = 1 AND toxic = 1 THEN 'sent' ELSE 'published' END AS status,
    CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS raw_title,
    CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS plaintext,
    lang || ',' || source AS tags_csv, {_dates('d.doc_id')}
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
posts AS (
  SELECT id, 'post' AS type, status, CASE WHEN raw_title = '' THEN '(untitled)' ELSE raw_title END AS title, id AS slug,
    CASE WHEN status <> 'draft' THEN '{SITE}/' || id || '/' END AS url, '{SITE}/ghost/#/editor/post/' || id AS editor_url,
    plaintext, tags_csv, CASE WHEN status <> 'draft' THEN published END AS published_at, updated_at
  FROM posts_raw),
pages_doc AS (
  SELECT 'p' || page_id AS id, 'page' AS type, 'published' AS status,
    CASE WHEN regexp_extract(html, '(?s)<title>(.*?)</title>', 1) = '' THEN '(untitled)'
         ELSE regexp_extract(html, '(?s)<title>(.*?)</title>', 1) END AS title,
    'p' || page_id AS slug, url, '{SITE}/ghost/#/editor/page/p' || page_id AS editor_url,
    regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'),
      '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS plaintext,
    '' AS tags_csv, published AS published_at, updated_at
  FROM (SELECT *, {_dates('page_id')} FROM pages)),
archive AS (SELECT {DOC} FROM posts UNION ALL SELECT {DOC} FROM pages_doc)"""

FOLD = f"translate(lower(replace({{x}}, 'Σ', 'σ')), '{t.ACCENTED}{t.DROPPED_MARKS}', '{t.UNACCENTED}')"


def fold(x: str) -> str:
    return FOLD.format(x=x)


TOKENS = f"""
token_lists AS (
  SELECT id, col, regexp_extract_all({fold('body')}, '{t.TERM_PATTERN}') AS l
  FROM (SELECT id, 'title' AS col, title AS body FROM archive
        UNION ALL SELECT id, 'plaintext', plaintext FROM archive
        UNION ALL SELECT id, 'tags', tags_csv FROM archive)),
tokens AS (SELECT id, col, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos FROM token_lists)"""


def stem_of(source: str, name: str = "stems") -> str:
    """CTEs that give the Porter stem of every term of `source` (one column `term`)."""
    def sfx(words):
        return f"(?:{'|'.join(words)})$"

    def split(n, prev, words):
        return (
            f"{name}_{n} AS MATERIALIZED (SELECT term, w, s, left(w, length(w) - length(s)) AS b FROM "
            f"(SELECT term, w, regexp_extract(w, '{sfx(words)}') AS s FROM {prev}))"
        )

    def case_map(table):
        return "CASE s " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"

    m0, m1, m_is1 = t.MEASURE_OVER_0, t.MEASURE_OVER_1, t.MEASURE_IS_1
    has = lambda col, p: f"regexp_matches({col}, '{p}')"
    return ",\n".join([
        f"{name}_a AS MATERIALIZED (SELECT term, regexp_replace(term, '^y', 'Y') AS w FROM {source})",
        f"{name}_b AS MATERIALIZED (SELECT term, CASE WHEN {has('w', '(?:..sses|.ies)$')} THEN left(w, length(w) - 2) "
        f"WHEN {has('w', '[^s]s$')} THEN left(w, length(w) - 1) ELSE w END AS w FROM {name}_a)",
        split("c", f"{name}_b", ("eed", "ed", "ing")),
        f"{name}_d AS MATERIALIZED (SELECT term, w, s, b, (s IN ('ed', 'ing') AND {has('b', t.HAS_VOWEL)}) OR w = 'eed' AS cut FROM {name}_c)",
        f"{name}_e AS MATERIALIZED (SELECT term, cut, CASE WHEN w = 'eed' THEN 'e' WHEN cut THEN b "
        f"WHEN s = 'eed' AND {has('b', m0)} THEN b || 'ee' ELSE w END AS w FROM {name}_d)",
        f"{name}_f AS MATERIALIZED (SELECT term, CASE WHEN NOT cut THEN w WHEN {has('w', '.(?:at|bl|iz)$')} THEN w || 'e' "
        f"WHEN {has('w', t.DOUBLE_END)} THEN left(w, length(w) - 1) "
        f"WHEN {has('w', m_is1)} AND {has('w', t.SHORT_END)} THEN w || 'e' ELSE w END AS w FROM {name}_e)",
        f"{name}_g AS MATERIALIZED (SELECT term, CASE WHEN w LIKE '%y' AND {has('left(w, length(w) - 1)', t.HAS_VOWEL)} "
        f"THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM {name}_f)",
        split("h", f"{name}_g", t.STEP2),
        f"{name}_i AS MATERIALIZED (SELECT term, CASE WHEN s <> '' AND {has('b', m0)} THEN b || {case_map(t.STEP2)} ELSE w END AS w FROM {name}_h)",
        split("j", f"{name}_i", t.STEP3),
        f"{name}_k AS MATERIALIZED (SELECT term, CASE WHEN s <> '' AND {has('b', m0)} THEN b || {case_map(t.STEP3)} ELSE w END AS w FROM {name}_j)",
        split("l", f"{name}_k", t.STEP4),
        f"{name}_m AS MATERIALIZED (SELECT term, CASE WHEN s <> '' AND {has('b', m1)} AND (s <> 'ion' OR b LIKE '%s' OR b LIKE '%t') THEN b ELSE w END AS w FROM {name}_l)",
        split("n", f"{name}_m", ("e",)),
        f"{name}_o AS MATERIALIZED (SELECT term, CASE WHEN s = 'e' AND ({has('b', m1)} OR ({has('b', m_is1)} AND NOT {has('b', t.SHORT_END)})) THEN b ELSE w END AS w FROM {name}_n)",
        f"{name}_p AS MATERIALIZED (SELECT term, CASE WHEN w LIKE '%ll' AND {has('w', m1)} THEN left(w, length(w) - 1) ELSE w END AS w FROM {name}_o)",
        f"{name} AS (SELECT term, CASE WHEN strlen(term) < 3 OR strlen(term) > 64 THEN term ELSE regexp_replace(w, '^Y', 'y') END AS stem FROM {name}_p)",
    ])


LOG = """
log_words AS (
  SELECT item_id * 10 + form AS query_id, form, ['en', 'fr', 'de', 'ES'][item_id % 4 + 1] AS lang, item_id % 3 AS y,
    list_filter(string_split(regexp_replace(replace(text, chr(10), ' '), '[":]', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM (SELECT *, unnest(range(10)) AS form FROM benchmark)),
log_parts AS (
  SELECT query_id, form, lang, y, coalesce(w[f + 1], 'the') AS w0, coalesce(w[f + 2], 'the') AS w1, coalesce(w[f + 3], 'the') AS w2,
    coalesce(w[f + 4], 'the') AS w3, coalesce(w[f + 5], 'the') AS w4, coalesce(w[f + 6], 'the') AS w5
  FROM (SELECT *, len(w) * form // 10 AS f FROM log_words)),
log AS (
  SELECT query_id, form >= 8 AS prefix_last, CASE form
    WHEN 0 THEN w0 || ' ' || w1
    WHEN 1 THEN '"' || w0 || ' ' || w1 || ' ' || w2 || '"'
    WHEN 2 THEN w0 || ' -' || w3
    WHEN 3 THEN 'title:' || w0
    WHEN 4 THEN w2 || ' tag:' || lang
    WHEN 5 THEN w1 || ' after:' || (2022 + y) || '-03 before:' || (2023 + y)
    WHEN 6 THEN w1 || ' status:sent'
    WHEN 7 THEN 'tag:' || lang || ' type:post before:' || (2023 + y)
    WHEN 8 THEN w0 || ' ' || substr(w1, 1, 4)
    ELSE '-' || w0 || ' TYPE:page "' || w4 || ' ' || w5 END AS raw
  FROM log_parts)"""

_KEY = "CASE WHEN open AND instr(txt, ':') > 1 AND substr(txt, instr(txt, ':') + 1) <> '' THEN lower(substr(txt, 1, instr(txt, ':') - 1)) ELSE '' END"
_DATE = (
    "CASE WHEN regexp_full_match(val, '[0-9]{4}') THEN val || '-01-01' WHEN regexp_full_match(val, '[0-9]{4}-[0-9]{2}') "
    "THEN val || '-01' WHEN regexp_full_match(val, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN val END"
)

PARSED = f"""
segments AS (
  SELECT query_id, prefix_last, unnest(l) AS seg, generate_subscripts(l, 1) - 1 AS i, len(l) AS n
  FROM (SELECT query_id, prefix_last, string_split(raw, '"') AS l FROM log)),
pieces AS (
  SELECT query_id, prefix_last, i, unnest(l) AS txt, generate_subscripts(l, 1) AS j, true AS open
  FROM (SELECT query_id, prefix_last, i, regexp_split_to_array(seg, '[{t.JS_SPACE}]+') AS l FROM segments WHERE i % 2 = 0)
  UNION ALL SELECT query_id, prefix_last, i, seg, 0, i = n - 1 FROM segments WHERE i % 2 = 1),
log_tokens AS (
  SELECT query_id, prefix_last, txt, open, row_number() OVER (PARTITION BY query_id ORDER BY i, j) - 1 AS clause_no
  FROM pieces WHERE txt <> ''),
keyed AS (SELECT *, substr(txt, instr(txt, ':') + 1) AS val, {_KEY} AS k FROM log_tokens),
kinds AS (
  SELECT *, CASE WHEN k IN ('title', 'tag') THEN k WHEN k IN ('before', 'after') AND {_DATE} IS NOT NULL THEN k
      WHEN k = 'status' AND lower(val) IN ('published', 'draft', 'scheduled', 'sent') THEN k
      WHEN k = 'type' AND lower(val) IN ('post', 'page') THEN k
      WHEN open AND txt LIKE '-_%' THEN 'negated' ELSE 'term' END AS kind FROM keyed),
valued AS (
  SELECT *, CASE WHEN kind IN ('title', 'tag') THEN val WHEN kind IN ('before', 'after') THEN {_DATE}
      WHEN kind IN ('status', 'type') THEN lower(val) WHEN kind = 'negated' THEN substr(txt, 2) ELSE txt END AS v FROM kinds),
queries AS (
  SELECT l.query_id, any_value(l.raw) AS raw,
    max_by(v, clause_no) FILTER (kind = 'tag') AS tag, max_by(v, clause_no) FILTER (kind = 'before') AS before,
    max_by(v, clause_no) FILTER (kind = 'after') AS after, max_by(v, clause_no) FILTER (kind = 'status') AS status,
    max_by(v, clause_no) FILTER (kind = 'type') AS type,
    count(*) FILTER (kind IN ('term', 'title')) AS n_positive,
    max(clause_no) FILTER (kind IN ('term', 'title')) AS last_positive
  FROM log l LEFT JOIN valued v ON l.query_id = v.query_id GROUP BY l.query_id),
clauses AS (
  SELECT v.query_id, v.clause_no, kind = 'negated' AS negated, kind = 'title' AS title_only,
    prefix_last AND clause_no = last_positive AND kind = 'term' AND open AS prefix, v AS text,
    regexp_extract_all({fold('v')}, '{t.TERM_PATTERN}') AS terms
  FROM valued v JOIN queries q ON v.query_id = q.query_id
  WHERE n_positive > 0 AND kind IN ('term', 'title', 'negated'))"""

MATCHES = f"""
raw_slots AS (
  SELECT query_id, clause_no, title_only, prefix, len(terms) AS n_terms, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS slot
  FROM clauses),
all_terms AS (SELECT DISTINCT term FROM tokens UNION SELECT DISTINCT term FROM raw_slots),
{stem_of('all_terms')},
slots AS (SELECT r.*, s.stem, prefix AND slot = n_terms - 1 AS as_prefix FROM raw_slots r JOIN stems s ON r.term = s.term),
archive_terms AS (SELECT DISTINCT t.term, s.stem FROM tokens t JOIN stems s ON t.term = s.term),
slot_terms AS (
  SELECT query_id, clause_no, title_only, n_terms, slot, a.term FROM slots s JOIN archive_terms a ON a.stem = s.stem WHERE NOT as_prefix
  UNION ALL
  SELECT query_id, clause_no, title_only, n_terms, slot, a.term FROM slots s JOIN archive_terms a ON starts_with(a.stem, s.stem) WHERE as_prefix),
places AS (
  SELECT query_id, clause_no, n_terms, id, col, pos - slot AS first
  FROM tokens t JOIN slot_terms s ON t.term = s.term WHERE NOT title_only OR col = 'title'
  GROUP BY query_id, clause_no, n_terms, id, col, pos - slot HAVING count(*) = n_terms),
matches AS (
  SELECT query_id, clause_no, id, sum(CASE col WHEN 'title' THEN 10.0::DOUBLE WHEN 'plaintext' THEN 1.0 ELSE 3.0 END) AS freq
  FROM places GROUP BY query_id, clause_no, id)"""

SCORES = """
lengths AS (SELECT a.id, count(t.term) AS n_tokens FROM archive a LEFT JOIN tokens t ON a.id = t.id GROUP BY a.id),
corpus AS (SELECT count(*) AS n_docs, avg(n_tokens) AS avg_len FROM lengths),
frequency AS (SELECT query_id, clause_no, count(*) AS n FROM matches GROUP BY query_id, clause_no),
idfs AS (SELECT query_id, clause_no, n, ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) AS raw_idf FROM frequency, corpus),
parts AS (
  SELECT m.query_id, m.id, m.clause_no, c.negated,
    (CASE WHEN raw_idf <= 0 THEN 1e-6::DOUBLE ELSE raw_idf END)
      * ((freq * 2.2::DOUBLE) / (freq + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_tokens / avg_len))) AS part
  FROM matches m JOIN clauses c ON m.query_id = c.query_id AND m.clause_no = c.clause_no
    JOIN idfs i ON m.query_id = i.query_id AND m.clause_no = i.clause_no JOIN lengths l ON m.id = l.id, corpus),
held AS (
  SELECT query_id, id, list(part ORDER BY clause_no) FILTER (NOT negated) AS l
  FROM parts GROUP BY query_id, id HAVING NOT bool_or(negated)),
passing AS (
  SELECT q.query_id, a.id, q.n_positive, a.published_at, a.updated_at
  FROM queries q JOIN archive a ON (q.status IS NULL OR q.status = a.status) AND (q.type IS NULL OR q.type = a.type)
    AND (q.after IS NULL OR a.published_at >= q.after) AND (q.before IS NULL OR a.published_at < q.before)
    AND (q.tag IS NULL OR (',' || a.tags_csv || ',') ILIKE ('%,' || q.tag || ',%'))),
scored AS (
  SELECT h.query_id, h.id, -list_sum(l) AS score FROM held h JOIN passing p ON h.query_id = p.query_id AND h.id = p.id
  WHERE len(l) = n_positive)"""

HITS = """
text_top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM scored) WHERE rank <= 50),
date_top AS (
  SELECT query_id, id, 0.0::DOUBLE AS score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY published_at DESC NULLS LAST, updated_at DESC, id) AS rank
    FROM passing WHERE n_positive = 0) WHERE rank <= 50),
top AS (SELECT query_id, id, score, rank FROM text_top UNION ALL SELECT query_id, id, score, rank FROM date_top)"""

SNIPPETS = f"""
bodies AS (
  SELECT query_id, t.id, plaintext, regexp_extract_all(plaintext, '{t.WORD_PATTERN}') AS words,
    regexp_split_to_array(plaintext, '{t.WORD_PATTERN}') AS gaps
  FROM text_top t JOIN archive a ON t.id = a.id),
sized AS (SELECT *, len(words) AS n_words FROM bodies),
inst AS (
  SELECT p.query_id, p.id, p.clause_no, p.first, p.first + n_terms - 1 AS last
  FROM places p JOIN text_top t ON p.query_id = t.query_id AND p.id = t.id WHERE col = 'plaintext'),
origins AS (SELECT DISTINCT query_id, id, first AS o FROM inst),
sentences AS (
  SELECT query_id, id, i AS s FROM (SELECT query_id, id, n_words, unnest(gaps) AS g, generate_subscripts(gaps, 1) - 1 AS i FROM sized)
  WHERE i < n_words AND (i = 0 OR regexp_matches(g, '[.:][ \\t\\n\\r]+$'))),
latest AS (
  SELECT o.query_id, o.id, o.o, max(s.s) AS s FROM origins o JOIN sentences s ON o.query_id = s.query_id AND o.id = s.id AND s.s <= o.o
  GROUP BY o.query_id, o.id, o.o),
tries AS (
  SELECT query_id, id, o, 0 AS turn, o AS spot FROM origins
  UNION ALL SELECT l.query_id, l.id, o, 1, s FROM latest l JOIN sized z ON l.query_id = z.query_id AND l.id = z.id WHERE s < o AND n_words > 12),
tried AS (
  SELECT t.query_id, t.id, o, turn, spot, 999 * count(DISTINCT clause_no) + count(*) AS points, max_by(last, (first, clause_no)) + 1 AS past
  FROM tries t JOIN inst i ON t.query_id = i.query_id AND t.id = i.id AND i.first >= spot AND i.first < spot + 12
  GROUP BY t.query_id, t.id, o, turn, spot),
windows AS (
  SELECT t.query_id, t.id, o, turn, points + CASE WHEN turn = 0 THEN 0 WHEN spot = 0 THEN 120 ELSE 100 END AS points,
    CASE WHEN turn = 1 THEN spot ELSE greatest(least(o - CAST(trunc((12 - (past - o)) / 2) AS BIGINT), n_words - 12), 0) END AS lo
  FROM tried t JOIN sized z ON t.query_id = z.query_id AND t.id = z.id),
chosen AS (
  SELECT * FROM (SELECT query_id, id, lo, row_number() OVER (PARTITION BY query_id, id ORDER BY points DESC, o, turn) AS n FROM windows) WHERE n = 1),
framed AS (
  SELECT z.*, coalesce(lo, 0) AS lo, least(coalesce(lo, 0) + 11, n_words - 1) AS hi
  FROM sized z LEFT JOIN chosen c ON z.query_id = c.query_id AND z.id = c.id),
run_marks AS (
  SELECT *, max(last) OVER (PARTITION BY query_id, id ORDER BY first, clause_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM inst),
run_ids AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR first > reach THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, id ORDER BY first, clause_no) AS r FROM run_marks),
runs AS (SELECT query_id, id, r, min(first) AS a, max(last) AS b FROM run_ids GROUP BY query_id, id, r),
shown AS (
  SELECT query_id, id, lo, hi, n_words, gaps, unnest(range(lo, hi + 1)) AS i, words FROM framed),
pieced AS (
  SELECT s.query_id, s.id, i,
    CASE WHEN i = lo AND lo > 0 THEN '' ELSE gaps[i + 1] END
    || CASE WHEN max(CASE WHEN a = i AND a >= lo THEN 1 ELSE 0 END) = 1 THEN '[' ELSE '' END || words[i + 1]
    || CASE WHEN max(CASE WHEN a >= lo AND (b = i OR (i = hi AND a <= i AND b > i)) THEN 1 ELSE 0 END) = 1 THEN ']' ELSE '' END AS piece
  FROM shown s LEFT JOIN runs r ON s.query_id = r.query_id AND s.id = r.id AND r.a <= s.i AND r.b >= s.i
  GROUP BY s.query_id, s.id, i, lo, hi, gaps, words),
joined AS (SELECT query_id, id, string_agg(piece, '' ORDER BY i) AS body FROM pieced GROUP BY query_id, id),
snips AS (
  SELECT f.query_id, f.id, CASE WHEN n_words = 0 THEN plaintext ELSE
    CASE WHEN lo > 0 THEN '…' ELSE '' END || j.body || CASE WHEN hi >= n_words - 1 THEN gaps[n_words + 1] ELSE '…' END END AS snippet
  FROM framed f LEFT JOIN joined j ON f.query_id = j.query_id AND f.id = j.id
  UNION ALL SELECT d.query_id, d.id, substr(a.plaintext, 1, 160) FROM date_top d JOIN archive a ON d.id = a.id),
hits AS (
  SELECT t.query_id, t.rank, a.*, s.snippet, t.score,
    CASE WHEN a.status IN ('published', 'sent') THEN coalesce(a.url, a.editor_url) ELSE a.editor_url END AS link,
    substr(coalesce(a.published_at, a.updated_at), 1, 10) AS display_date
  FROM top t JOIN archive a ON t.id = a.id JOIN snips s ON t.query_id = s.query_id AND t.id = s.id)"""

SEARCH = ",".join((ARCHIVE, TOKENS, LOG, PARSED, MATCHES, SCORES, HITS))
FULL = ",".join((SEARCH, SNIPPETS))


def over(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"
