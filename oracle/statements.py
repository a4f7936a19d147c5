"""One DuckDB statement per catalog query."""

from __future__ import annotations

from oracle.ctes import ARCHIVE, FULL, LOG, MATCHES, PARSED, SEARCH, SITE, TOKENS, over, stem_of

WATERMARK = "2024-06-01T00:00:00.000Z"
NOW = "2026-01-01T12:00:00.000Z"
DOC = "id, type, status, title, slug, url, editor_url, plaintext, tags_csv, published_at, updated_at"

# The landed records after cleaning.
LANDED = ARCHIVE + f""",
landed AS (
  SELECT id, 'post' AS type,
    CASE WHEN quality IS NULL OR (quality = 0 AND toxic = 0) THEN 'draft' ELSE status END AS status,
    CASE WHEN raw_title = '' THEN '(untitled)' ELSE raw_title END AS title, id AS slug,
    CASE WHEN status <> 'draft' THEN '{SITE}/' || id || '/' END AS url, '{SITE}/ghost/#/editor/post/' || id AS editor_url, plaintext,
    CASE WHEN lang = 'de' THEN source ELSE lang || ',' || source END AS tags_csv,
    CASE WHEN status <> 'draft' THEN published END AS published_at, updated_at FROM posts_raw
  UNION ALL
  SELECT id, type, 'draft', title, slug, url, editor_url, plaintext, '', published_at, updated_at FROM pages_doc)"""

BATCH = ARCHIVE + f""",
changed AS (SELECT * FROM posts WHERE updated_at > '{WATERMARK}'),
batch AS (
  SELECT id, type, status, title || ' (edited)' AS title, slug, url, editor_url, plaintext, tags_csv, published_at, updated_at, 1 AS seq FROM changed
  UNION ALL SELECT id, type, status, title || ' (edited twice)', slug, url, editor_url, plaintext, tags_csv, published_at, updated_at, 2
    FROM changed WHERE status = 'sent'
  UNION ALL SELECT {DOC}, 1 FROM pages_doc),
merged AS (
  SELECT {DOC} FROM posts WHERE id NOT IN (SELECT id FROM batch)
  UNION ALL SELECT {DOC} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM batch) WHERE n = 1)"""

LIVE = ARCHIVE + """,
live AS (SELECT id FROM posts WHERE status IN ('published', 'sent') UNION SELECT id FROM pages_doc)"""

LINK = "CASE WHEN status IN ('published', 'sent') THEN coalesce(url, editor_url) ELSE editor_url END"
DATE = "substr(coalesce(published_at, updated_at), 1, 10)"
DRAFT = "status NOT IN ('published', 'sent')"

MATCHING = ",".join((ARCHIVE, TOKENS, LOG, PARSED, MATCHES)) + """,
clause_keys AS (
  SELECT query_id, clause_no, len(terms) AS n_terms,
    concat_ws(' ', CASE WHEN title_only THEN 'title' ELSE 'any' END, CASE WHEN prefix THEN 'prefix' ELSE 'whole' END, sha256(array_to_string(terms, ' '))) AS clause_key
  FROM clauses),
key_matches AS (
  SELECT DISTINCT clause_key, n_terms, id, freq FROM matches m JOIN clause_keys k ON m.query_id = k.query_id AND m.clause_no = k.clause_no),
held_ids AS (
  SELECT m.query_id, id FROM matches m JOIN clauses c ON m.query_id = c.query_id AND m.clause_no = c.clause_no
    JOIN queries q ON m.query_id = q.query_id
  GROUP BY m.query_id, id, n_positive HAVING count(*) FILTER (NOT negated) = n_positive AND NOT bool_or(negated))"""

JS_SPACES = r"[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{JS_SPACES}', ' ', 'g'))"


def posting_rows(ctes: str) -> str:
    return over(ctes, """SELECT term, id, col, CASE col WHEN 'title' THEN 10.0::DOUBLE WHEN 'plaintext' THEN 1.0 ELSE 3.0 END AS weight,
  string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM tokens GROUP BY term, id, col""")


def archive_filter(condition: str) -> str:
    return over(ARCHIVE, f"SELECT id FROM archive WHERE {condition}")


def tag_is(value: str) -> str:
    return f"(',' || tags_csv || ',') ILIKE '%,{value},%'"


TEXT_LINES = f"""lpad(CAST(rank AS VARCHAR), greatest(2, length(CAST(rank AS VARCHAR)))::INTEGER, ' ') || '. ' || title ||
    CASE WHEN {DRAFT} THEN ' [' || status || ']' ELSE '' END || '  ' || display_date || chr(10) || '    ' || link ||
    CASE WHEN {collapsed('snippet')} = '' THEN '' ELSE chr(10) || '    ' || {collapsed('snippet')} END"""

# A cleaned copy of the archive under the name the token CTEs read.
MERGED_TOKENS = BATCH.replace("\narchive AS", "\nwhole_archive AS") + f",\narchive AS (SELECT {DOC} FROM merged)," + TOKENS
LANDED_TOKENS = LANDED.replace("\narchive AS", "\nwhole_archive AS") + f",\narchive AS (SELECT {DOC} FROM landed)," + TOKENS
LANDED_HITS = LANDED.replace("\narchive AS", "\nwhole_archive AS") + f",\narchive AS (SELECT {DOC} FROM landed)" + FULL[len(ARCHIVE):]
STILL_LIVE = "id IN (SELECT id FROM posts WHERE status IN ('published', 'sent') UNION SELECT id FROM pages_doc)"
PRUNED_HITS = LANDED_HITS.replace("FROM landed)", f"FROM landed WHERE {STILL_LIVE})")
TYPED = FULL.replace("form >= 8 AS prefix_last", "true AS prefix_last")

STATEMENTS: dict[str, str] = {
    "read_api_pages": over(ARCHIVE, """
SELECT 'post' AS type, doc_id // 100 + 1 AS page, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS item, id, raw_title AS title FROM posts_raw
UNION ALL SELECT 'page', n // 100 + 1, row_number() OVER (PARTITION BY n // 100 ORDER BY n) - 1, id, title FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM pages_doc)"""),
    "page_coverage": """
SELECT 'post' AS type, max(doc_id) // 100 + 1 AS pages, count(*) AS total, count(*) AS n_docs, 0::BIGINT AS n_missing FROM documents
UNION ALL SELECT 'page', max(page_id) // 100 + 1, count(*), count(*), 0::BIGINT FROM pages""",
    "read_ids": over(ARCHIVE, "SELECT id, updated_at FROM archive"),
    "write_documents": over(ARCHIVE, f"SELECT {DOC} FROM archive"),
    "sync_state": "SELECT source AS key, max_by(lang || '-' || doc_id, doc_id) AS value FROM documents GROUP BY source",
    "hits_to_json": over(FULL, """
SELECT query_id, rank, id, type, status, title, slug, link, url, editor_url AS "editorUrl",
  CASE WHEN tags_csv = '' THEN '[]' ELSE '["' || replace(tags_csv, ',', '","') || '"]' END AS tags,
  published_at AS "publishedAt", updated_at AS "updatedAt", snippet, round(score, 6) AS score, true AS keeps_nulls, false AS has_body FROM hits"""),
    "hits_json_array": over(FULL, f"""
SELECT l.query_id, count(h.id) AS n_hits, count(h.id) = 0 AS is_empty, max(h.id) FILTER (h.rank = 1) AS first_id,
  max(h.link) FILTER (h.rank = 2) AS second_link
FROM log l LEFT JOIN hits h ON l.query_id = h.query_id GROUP BY l.query_id"""),
    "stored_size": over(ARCHIVE, "SELECT true AS has_bytes, true AS is_readable, count(*) AS n_docs FROM archive"),
    "large_limit": over(SEARCH.replace("<= 50", "<= 5000"), "SELECT query_id, rank, id, round(score, 6) AS score FROM top"),
    "incomplete_landing": over(ARCHIVE, f"""
SELECT step, count(*) AS n_docs, '{WATERMARK}' AS last_sync_at FROM archive, (VALUES ('landing'), ('listing')) s(step) GROUP BY step"""),
    "page_wise_commit": f"""
WITH placed AS (SELECT doc_id // 100 + 1 AS page FROM documents UNION ALL SELECT page_id // 100 + 1 FROM pages)
SELECT 'broken' AS step, count(*) FILTER (page % 3 = 1) AS n_docs, NULL::VARCHAR AS last_sync_at FROM placed
UNION ALL SELECT 'whole', count(*), '{WATERMARK}' FROM placed UNION ALL SELECT 'again', count(*), '{NOW}' FROM placed""",
    "same_id_two_types": """
SELECT 'd' || coalesce(doc_id, page_id) AS id, CASE WHEN page_id IS NULL THEN 'post' ELSE 'page' END AS type
FROM documents FULL JOIN pages ON doc_id = page_id""",
    "hits_to_text": over(FULL, f"SELECT query_id, rank, {TEXT_LINES} AS text FROM hits"),
    "result_lists": over(FULL, f"""
SELECT l.query_id, coalesce(string_agg(t.text, chr(10) || chr(10) ORDER BY t.rank), 'No matches. Try fewer words, or drop any tag: and date filters.') AS text
FROM log l LEFT JOIN (SELECT query_id, rank, {TEXT_LINES} AS text FROM hits) t ON l.query_id = t.query_id GROUP BY l.query_id"""),
    "normalize_documents": over(LANDED, f"SELECT {DOC} FROM landed"),
    "require_id": """
SELECT CASE WHEN l.doc_id IS NULL THEN 'rejected' ELSE 'accepted' END AS outcome, source, count(*) AS n
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2""",
    "status_default": over(LANDED, "SELECT id, status FROM landed"),
    "title_default": over(LANDED, "SELECT id, title FROM landed"),
    "string_defaults": over(LANDED, "SELECT id, slug, plaintext, updated_at, url, published_at FROM landed"),
    "tag_slugs": over(LANDED, "SELECT id, tags_csv FROM landed"),
    "editor_link": over(LANDED, "SELECT id, editor_url FROM landed"),
    "document_links": over(ARCHIVE, f"SELECT id, {LINK} AS link FROM archive"),
    "markdown_link": over(ARCHIVE, f"SELECT id, '[' || replace(replace(title, '[', '\\['), ']', '\\]') || '](' || {LINK} || ')' AS markdown FROM archive"),
    "draft_flag": over(ARCHIVE, f"SELECT id, {DRAFT} AS is_draft FROM archive"),
    "display_date": over(ARCHIVE, f"SELECT id, {DATE} AS display_date FROM archive"),
    "tag_csv_codec": over(ARCHIVE, """
SELECT id, tags_csv, CASE WHEN tags_csv = '' THEN 0 ELSE len(string_split(tags_csv, ',')) END::BIGINT AS n_tags,
  CASE WHEN tags_csv <> '' THEN split_part(tags_csv, ',', 1) END AS first_tag FROM archive"""),
    "leading_excerpt": over(ARCHIVE, "SELECT id, substr(plaintext, 1, 160) AS excerpt FROM archive"),
    "article_cards": over(FULL, f"""
SELECT query_id, rank, title || chr(10) || display_date || '  ·  ' || type || CASE WHEN tags_csv = '' THEN '' ELSE '  ·  ' || replace(tags_csv, ',', ', ') END
  || CASE WHEN {DRAFT} THEN '  ·  ' || status ELSE '' END || chr(10) || link || chr(10) || chr(10)
  || CASE WHEN body <> '' THEN body WHEN {collapsed('snippet')} <> '' THEN {collapsed('snippet')} ELSE 'This post has no body text.' END AS card
FROM (SELECT *, regexp_replace(regexp_replace(plaintext, '^{JS_SPACES}', ''), '{JS_SPACES}$', '') AS body FROM hits)"""),
    "tag_filter": archive_filter(tag_is("SRC1")),
    "tag_filter_wildcard": archive_filter(tag_is("s_c1%")),
    "tag_filter_spanning": archive_filter(tag_is("en,src1")),
    "status_filter": archive_filter("status = 'sent'"),
    "type_filter": archive_filter("type = 'page'"),
    "after_filter": archive_filter("published_at >= '2024-03-01'"),
    "before_filter": archive_filter("published_at < '2023-06-15'"),
    "filter_conjunction": archive_filter(
        f"{tag_is('fr')} AND status = 'published' AND type = 'post' AND published_at >= '2022-06-01' AND published_at < '2025-01-01'"
    ),
    "changed_since": over(ARCHIVE, f"SELECT id, updated_at FROM archive WHERE updated_at > '{WATERMARK}'"),
    "empty_body": archive_filter("plaintext = ''"),
    "index_documents_join": over(",".join((ARCHIVE, TOKENS)), """
SELECT a.id, a.title, n_postings FROM (SELECT id, count(DISTINCT (term, col)) AS n_postings FROM tokens GROUP BY id) p JOIN archive a ON p.id = a.id"""),
    "term_lookup": over(MATCHING, """
SELECT clause_key, slot, s.term, t.id, t.col, count(DISTINCT pos) AS n_places FROM slot_terms s
  JOIN clause_keys k ON s.query_id = k.query_id AND s.clause_no = k.clause_no JOIN tokens t ON t.term = s.term
WHERE NOT title_only OR t.col = 'title' GROUP BY clause_key, slot, s.term, t.id, t.col"""),
    "phrase_match": over(MATCHING, "SELECT clause_key, id, freq FROM key_matches WHERE n_terms > 1"),
    "not_match": over(MATCHING, "SELECT query_id, id FROM held_ids WHERE query_id IN (SELECT query_id FROM clauses WHERE negated)"),
    "existing_id_probe": over(BATCH, "SELECT id, count(*) AS n_records, id IN (SELECT id FROM posts) AS known FROM batch GROUP BY id"),
    "prune_join": over(LIVE, "SELECT count(*) AS removed FROM archive WHERE id NOT IN (SELECT id FROM live)"),
    "prefix_lookup": over(MATCHING, """
SELECT DISTINCT clause_key, s.slot, a.term FROM slots s JOIN clause_keys k ON s.query_id = k.query_id AND s.clause_no = k.clause_no
  JOIN archive_terms a ON starts_with(a.stem, s.stem) WHERE as_prefix"""),
    "document_count": over(ARCHIVE, "SELECT count(*) AS n_docs FROM archive"),
    "document_ids": over(ARCHIVE, "SELECT DISTINCT id FROM archive"),
    "empty_body_count": over(ARCHIVE, "SELECT count(*) FILTER (plaintext = '') AS n_empty FROM archive"),
    "empty_body_alarm": over(ARCHIVE, """
SELECT n_docs, n_empty, n_docs > 0 AND n_empty >= 0.9 * n_docs AS alarm FROM (SELECT count(*) AS n_docs, count(*) FILTER (plaintext = '') AS n_empty FROM archive)"""),
    "merge_counts": over(BATCH, """
SELECT a AS added, n - a AS updated FROM (SELECT count(*) AS n, count(DISTINCT id) FILTER (id NOT IN (SELECT id FROM posts)) AS a FROM batch)"""),
    "type_counts": over(ARCHIVE, "SELECT type, count(*) AS n_docs FROM archive GROUP BY type"),
    "status_report": over(ARCHIVE, f"""
SELECT n_docs, last AS last_sync_at, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || CASE WHEN m = 1 THEN ' minute ago' ELSE ' minutes ago' END
  WHEN m < 1440 THEN m // 60 || CASE WHEN m // 60 = 1 THEN ' hour ago' ELSE ' hours ago' END
  ELSE m // 1440 || CASE WHEN m // 1440 = 1 THEN ' day ago' ELSE ' days ago' END END AS age
FROM (SELECT *, date_diff('second', strptime(last, '%Y-%m-%dT%H:%M:%S.%gZ'), strptime('{NOW}', '%Y-%m-%dT%H:%M:%S.%gZ')) // 60 AS m
  FROM (SELECT count(*) AS n_docs, max(updated_at) AS last FROM archive))"""),
    "document_frequency": over(MATCHING, "SELECT clause_key, count(*) AS n_docs FROM key_matches GROUP BY clause_key"),
    "corpus_statistics": over(",".join((ARCHIVE, TOKENS)), """
SELECT n AS n_docs, round((SELECT count(*) FROM tokens)::DOUBLE / n, 6) AS avg_len FROM (SELECT count(*) AS n FROM archive)"""),
    "and_match": over(MATCHING, "SELECT query_id, id FROM held_ids"),
    "hit_count": over(SEARCH, "SELECT l.query_id, count(t.id) AS n_hits FROM log l LEFT JOIN top t ON l.query_id = t.query_id GROUP BY l.query_id"),
    "newest_first": over(ARCHIVE, """
SELECT id, published_at, updated_at FROM archive ORDER BY published_at DESC NULLS LAST, updated_at DESC, id LIMIT 50"""),
    "best_first": over(SEARCH, "SELECT query_id, rank, id FROM text_top"),
    "default_limit": over(SEARCH, "SELECT query_id, count(*) AS n_hits FROM top GROUP BY query_id"),
    "live_ids": over(LIVE, "SELECT id FROM live"),
    "stale_ids": over(LIVE, "SELECT id FROM archive EXCEPT SELECT id FROM live"),
    "tokenize": over(",".join((ARCHIVE, TOKENS)), "SELECT id, col, pos, term FROM tokens"),
    "stem_vocabulary": over(",".join((ARCHIVE, TOKENS)) + ", vocab_terms AS MATERIALIZED (SELECT term, count(DISTINCT id) AS n_docs FROM tokens GROUP BY term),"
        + stem_of("vocab_terms"), "SELECT v.term, stem, n_docs FROM vocab_terms v JOIN stems s ON v.term = s.term"),
    "build_postings": posting_rows(",".join((ARCHIVE, TOKENS))),
    "doc_lengths": over(",".join((ARCHIVE, TOKENS)), "SELECT a.id, count(t.term) AS n_tokens FROM archive a LEFT JOIN tokens t ON a.id = t.id GROUP BY a.id"),
    "update_postings": posting_rows(MERGED_TOKENS),
    "search_log_queries": over(",".join((LOG, PARSED)), "SELECT query_id, raw, tag, before, after, status, type, n_positive FROM queries"),
    "search_log_clauses": over(",".join((LOG, PARSED)), """
SELECT query_id, clause_no, negated, title_only, prefix, text, array_to_string(terms, ' ') AS terms FROM clauses"""),
    "term_match": over(MATCHING, "SELECT clause_key, id, freq FROM key_matches WHERE n_terms = 1"),
    "title_scope": over(MATCHING, "SELECT clause_key, id, freq FROM key_matches WHERE clause_key LIKE 'title %'"),
    "prefix_last_term": over(MATCHING, "SELECT clause_key, id, freq FROM key_matches WHERE clause_key LIKE 'any prefix %'"),
    "bm25_topk": over(SEARCH, "SELECT query_id, rank, id, round(score, 6) AS score FROM text_top"),
    "snippets": over(FULL, "SELECT query_id, id, snippet FROM hits"),
    "highlight_bodies": over(FULL + r""",
bare AS (
  SELECT query_id, i, regexp_replace(regexp_replace(word, '^[-"]+', ''), '"+$', '') AS word
  FROM (SELECT query_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT query_id, string_split(raw, ' ') AS l FROM log))
  WHERE NOT regexp_matches(word, '(?i)^(tag|before|after|status|type|title):')),
patterns AS (
  SELECT query_id, '(?i)(' || string_agg(regexp_replace(word, '([.*+?^${}()|\[\]\\])', '\\\1', 'g'), '|' ORDER BY i) || ')' AS p
  FROM bare WHERE length(word) >= 2 GROUP BY query_id)""",
        r"""SELECT h.query_id, id, CASE WHEN p IS NULL THEN plaintext ELSE regexp_replace(plaintext, p, '<<\1>>', 'g') END AS highlighted
FROM hits h LEFT JOIN patterns p ON h.query_id = p.query_id"""),
    "search_batch": over(FULL, f"SELECT query_id, rank, {DOC}, snippet, round(score, 6) AS score FROM hits"),
    "search_one": over(FULL.replace("CASE form\n", "CASE WHEN true THEN 'the that -tion after:2022' ELSE CASE form\n").replace(
        "ELSE '-' || w0 || ' TYPE:page \"' || w4 || ' ' || w5 END AS raw", "ELSE '' END END AS raw").replace(
        "form >= 8 AS prefix_last", "false AS prefix_last").replace("FROM log_parts)", "FROM log_parts WHERE query_id = 0)"),
        "SELECT rank, id, title, snippet, round(score, 6) AS score FROM hits"),
    "no_text_route": over(FULL, "SELECT query_id, rank, id, snippet FROM hits WHERE score = 0"),
    "merge_documents": over(BATCH, f"SELECT {DOC} FROM merged"),
    "plan_sync": over(ARCHIVE, f"""
SELECT 'first' AS run, count(*) AS n_docs FROM archive UNION ALL SELECT 'full', count(*) FROM archive
UNION ALL SELECT 'incremental', count(*) FROM archive WHERE updated_at > '{WATERMARK}'"""),
    "sync_archive": over(ARCHIVE, f"""
SELECT (SELECT count(*) FROM pages_doc WHERE updated_at > '{WATERMARK}') AS added, (SELECT count(*) FROM posts WHERE updated_at > '{WATERMARK}') AS updated,
  (SELECT count(*) FROM pages_doc WHERE updated_at > '{WATERMARK}') AS removed"""),
    "watermark_advance": over(ARCHIVE, f"""
SELECT count(*) AS n_docs, count(*) AS first_added, 0::BIGINT AS first_updated, 0::BIGINT AS first_removed, 0::BIGINT AS second_added,
  count(*) FILTER (type = 'post') AS first_seen_post, count(*) FILTER (type = 'page') AS first_seen_page,
  count(*) FILTER (type = 'post' AND updated_at > '{WATERMARK}') AS second_seen_post,
  count(*) FILTER (type = 'page' AND updated_at > '{WATERMARK}') AS second_seen_page,
  count(*) FILTER (updated_at > '{WATERMARK}') AS second_updated, 0::BIGINT AS second_removed, '{NOW}' AS last_sync_at FROM archive"""),
    "prune": over(LIVE, "SELECT id, status FROM archive WHERE id IN (SELECT id FROM live)"),
    "stream_archive": over(LANDED, f"SELECT {DOC} FROM landed"),
    "stream_postings": posting_rows(LANDED_TOKENS),
    "search_after_feed": over(LANDED_HITS, "SELECT query_id, rank, id, round(score, 6) AS score, snippet FROM hits"),
    "search_after_prune": over(PRUNED_HITS, "SELECT query_id, rank, id, round(score, 6) AS score, snippet FROM hits"),
    "stream_prune": over(LANDED, f"SELECT {DOC} FROM landed WHERE {STILL_LIVE}"),
    "compaction": posting_rows(LANDED_TOKENS),
    "out_of_order_guard": over(LANDED, """
SELECT l.id, CASE WHEN newer THEN 'held' ELSE l.title END AS title, CASE WHEN newer THEN '9' || l.updated_at ELSE l.updated_at END AS updated_at
FROM (SELECT l.*, r.quality IS NOT NULL OR (l.type = 'page' AND right(l.id, 1) IN ('1', '3', '5', '7', '9')) AS newer
      FROM landed l LEFT JOIN posts_raw r ON l.id = r.id) l"""),
    "stream_search": over(TYPED, "SELECT query_id, rank, id, round(score, 6) AS score FROM hits"),
}
