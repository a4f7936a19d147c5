"""Every operator as a query over the supplied tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import fields
from inkwell.operators import cleaning, filters, indexing, matching, merging, ranking, reports, searchlog
from inkwell.operators.highlighting import highlight
from inkwell.plans import search as searching
from inkwell.plans import sync
from inkwell.plans.index import ArchiveIndex, build_index
from inkwell.session import scratch_path
from inkwell.sources import api_pages, archive, testtables
from inkwell.sources.testtables import SITE
from inkwell.streaming import feed, livesearch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WATERMARK = "2024-06-01T00:00:00.000Z"
NOW = "2026-01-01T12:00:00.000Z"
INDEX_BUCKETS = 8

_shared: dict[tuple, object] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _once(kind: str, spark: SparkSession, sf_dir: str, make):
    """Stored intermediate data that several queries read, written once per application."""
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def index_for(spark: SparkSession, sf_dir: str) -> ArchiveIndex:
    def make():
        return build_index(spark, testtables.archive(spark, sf_dir), scratch_path(spark, "index"), INDEX_BUCKETS)

    return _once("index", spark, sf_dir, make)


def hits_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of the whole search log, stored."""
    def make():
        log = testtables.search_log(spark, sf_dir)
        return searching.settle(searching.search_batch(index_for(spark, sf_dir), log), "hits")

    return _once("hits", spark, sf_dir, make)


def landed_for(spark: SparkSession, sf_dir: str) -> str:
    """The tables as landed API pages; returns the folder."""
    def make():
        root = scratch_path(spark, "landed")
        testtables.landed_pages(testtables.raw_json_posts(spark, sf_dir), "posts", root)
        testtables.landed_pages(testtables.raw_json_pages(spark, sf_dir), "pages", root)
        return root

    return _once("landed", spark, sf_dir, make)


def parsed_for(spark: SparkSession, sf_dir: str) -> searching.ParsedLog:
    """The search log parsed under its own query ids."""
    return _once("parsed", spark, sf_dir, lambda: searching.read_log(testtables.search_log(spark, sf_dir)))


def _landed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api_pages.page_documents(api_pages.read_all_types(spark, landed_for(spark, sf_dir)))


def _landed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.normalize_documents(_landed_records(spark, sf_dir), SITE)


def _flat(docs: DataFrame) -> DataFrame:
    return docs.withColumn("tags_csv", fields.tags_to_csv(F.col("tags"))).drop("tags")


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes since the watermark: each changed post, the sent ones a second time, all pages."""
    changed = filters.changed_since(testtables.posts(spark, sf_dir), WATERMARK)
    edited = lambda note: F.concat("title", F.lit(note))
    first = changed.withColumn("title", edited(" (edited)")).withColumn("seq", F.lit(1))
    second = changed.where("status = 'sent'").withColumn("title", edited(" (edited twice)")).withColumn("seq", F.lit(2))
    return first.unionByName(second).unionByName(testtables.pages(spark, sf_dir).withColumn("seq", F.lit(1)))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the site still returns: public posts and all pages."""
    public = testtables.posts(spark, sf_dir).where(~fields.is_draft(F.col("status")))
    return merging.live_ids(public, testtables.pages(spark, sf_dir))


def _numbered(spark: SparkSession, sf_dir: str) -> tuple[searching.ParsedLog, DataFrame]:
    """The parsed log with numbers as clause keys, and the keys that they stand for."""
    return _once("numbered", spark, sf_dir, lambda: searching.with_clause_numbers(parsed_for(spark, sf_dir)))


def _slot_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        "slot_terms", spark, sf_dir,
        lambda: searching.clause_terms(index_for(spark, sf_dir), _numbered(spark, sf_dir)[0]),
    )


def _named(spark: SparkSession, sf_dir: str, rows: DataFrame, which: Column | None = None) -> DataFrame:
    """Rows under the keys of their clauses; `which` is a condition on the keys."""
    names = _numbered(spark, sf_dir)[1].withColumnRenamed("clause_key", "name")
    if which is not None:
        names = names.where(which)
    named = rows.join(names, F.col("clause_key") == F.col("number"))
    return named.withColumn("clause_key", F.col("name")).select(*rows.columns)


def _matches(spark: SparkSession, sf_dir: str, kind: str = "") -> DataFrame:
    """The matches of the clauses whose key begins with `kind`."""
    log, names = _numbered(spark, sf_dir)
    slot_terms = _slot_terms(spark, sf_dir)
    if kind:
        wanted = names.where(F.col("clause_key").startswith(kind)).select(F.col("number").alias("clause_key"))
        slot_terms = slot_terms.join(wanted, "clause_key", "left_semi")
    return searching.clause_matches(index_for(spark, sf_dir), log, slot_terms, with_facts=False)


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, slot_terms = index_for(spark, sf_dir), _slot_terms(spark, sf_dir)
    candidates = searching.settle(matching.phrase_candidates(slot_terms, index.postings, index.buckets), "candidates")
    return matching.match_phrases(slot_terms, index.postings, candidates, index.buckets)


def _single_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_for(spark, sf_dir)
    return matching.match_single_terms(_slot_terms(spark, sf_dir), index.postings, index.buckets)


def _match_rows(spark: SparkSession, sf_dir: str, matches: DataFrame) -> DataFrame:
    return _named(spark, sf_dir, matches.select("clause_key", "id", "freq"))


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searching.held_documents(index_for(spark, sf_dir), _numbered(spark, sf_dir)[0], _slot_terms(spark, sf_dir), with_filters=False)


# --- scans, sources, sinks ------------------------------------------------------------------
@query
def read_api_pages(spark, sf_dir):
    doc = F.col("doc")
    return _landed_records(spark, sf_dir).select(
        "type", F.col("page").cast("long").alias("page"), F.col("item").cast("long").alias("item"),
        fields.variant_string(doc, "$.id").alias("id"), fields.variant_string(doc, "$.title").alias("title"),
    )


@query
def page_coverage(spark, sf_dir):
    return api_pages.page_coverage(api_pages.read_all_types(spark, landed_for(spark, sf_dir)))


@query
def read_ids(spark, sf_dir):
    return api_pages.read_ids(_landed_records(spark, sf_dir))


@query
def write_documents(spark, sf_dir):
    return _flat(archive.write_documents(testtables.archive(spark, sf_dir), scratch_path(spark, "snapshot")))


@query
def sync_state(spark, sf_dir):
    raw = testtables.table(spark, sf_dir, "documents")
    entries = raw.select(F.col("source").alias("key"), F.concat("lang", F.lit("-"), F.col("doc_id").cast("string")).alias("value"), F.col("doc_id").alias("seq"))
    path = scratch_path(spark, "state")
    archive.write_state(entries, path)
    return archive.read_state(spark, path)


@query
def hits_to_json(spark, sf_dir):
    rows = reports.hits_to_json(hits_for(spark, sf_dir))
    text = ("id", "type", "status", "title", "slug", "link", "url", "editorUrl", "tags", "publishedAt", "updatedAt", "snippet")
    part = lambda name: F.get_json_object("json", f"$.{name}")
    return rows.select(
        "query_id", "rank", *(part(name).alias(name) for name in text),
        F.round(part("score").cast("double"), 6).alias("score"),
        F.contains("json", F.lit('"url":')).alias("keeps_nulls"),
        F.contains("json", F.lit('"plaintext":')).alias("has_body"),
    )


@query
def hits_json_array(spark, sf_dir):
    """The array form, with an empty array for searches that find nothing."""
    rows = reports.hits_to_json_array(testtables.search_log(spark, sf_dir), hits_for(spark, sf_dir))
    return rows.select(
        "query_id", F.json_array_length("json").cast("long").alias("n_hits"), (F.col("json") == "[]").alias("is_empty"),
        F.get_json_object("json", "$[0].id").alias("first_id"), F.get_json_object("json", "$[1].link").alias("second_link"),
    )


@query
def hits_to_text(spark, sf_dir):
    return reports.hits_to_text(hits_for(spark, sf_dir))


@query
def result_lists(spark, sf_dir):
    return reports.result_lists(testtables.search_log(spark, sf_dir), hits_for(spark, sf_dir))


# --- cleaning ---------------------------------------------------------------------------------
@query
def normalize_documents(spark, sf_dir):
    return _flat(_landed_documents(spark, sf_dir))


@query
def require_id(spark, sf_dir):
    docs, labels = (testtables.table(spark, sf_dir, name) for name in ("documents", "labels"))
    labelled = docs.join(labels, "doc_id", "left").select(
        F.when(F.col("quality").isNotNull(), F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("id"), "source"
    )
    raw = labelled.select(
        F.lit("post").alias("type"), F.lit(1).alias("page"), F.lit(0).alias("item"),
        F.parse_json(F.to_json(F.struct("id", F.col("source").alias("slug")))).alias("doc"),
    )
    accepted, rejects = cleaning.split_rejects(raw, SITE)
    source = F.get_json_object("raw", "$.slug")
    rows = accepted.select(F.lit("accepted").alias("outcome"), F.col("slug").alias("source")).unionByName(
        rejects.select(F.lit("rejected").alias("outcome"), source.alias("source"))
    )
    return rows.groupBy("outcome", "source").agg(F.count("*").alias("n"))


@query
def status_default(spark, sf_dir):
    return _landed_documents(spark, sf_dir).select("id", "status")


@query
def title_default(spark, sf_dir):
    return _landed_documents(spark, sf_dir).select("id", "title")


@query
def string_defaults(spark, sf_dir):
    return _landed_documents(spark, sf_dir).select("id", "slug", "plaintext", "updated_at", "url", "published_at")


@query
def tag_slugs(spark, sf_dir):
    return _flat(_landed_documents(spark, sf_dir).select("id", "tags"))


@query
def editor_link(spark, sf_dir):
    return _landed_documents(spark, sf_dir).select("id", "editor_url")


@query
def document_links(spark, sf_dir):
    return fields.document_links(testtables.archive(spark, sf_dir)).select("id", "link")


@query
def markdown_link(spark, sf_dir):
    return fields.document_links(testtables.archive(spark, sf_dir)).select("id", "markdown")


@query
def draft_flag(spark, sf_dir):
    return fields.document_links(testtables.archive(spark, sf_dir)).select("id", "is_draft")


@query
def display_date(spark, sf_dir):
    return fields.document_links(testtables.archive(spark, sf_dir)).select("id", "display_date")


@query
def tag_csv_codec(spark, sf_dir):
    csv = fields.tags_to_csv(F.col("tags"))
    stored = testtables.archive(spark, sf_dir).select("id", csv.alias("tags_csv"))
    back = fields.csv_to_tags(F.col("tags_csv"))
    return stored.select("id", "tags_csv", F.size(back).cast("long").alias("n_tags"), F.get(back, F.lit(0)).alias("first_tag"))


@query
def leading_excerpt(spark, sf_dir):
    return testtables.archive(spark, sf_dir).select("id", fields.excerpt(F.col("plaintext")).alias("excerpt"))


@query
def article_cards(spark, sf_dir):
    return reports.article_cards(hits_for(spark, sf_dir))


# --- filters ----------------------------------------------------------------------------------
def _filtered(**conditions) -> Query:
    return lambda spark, sf_dir: filters.filter_documents(testtables.archive(spark, sf_dir), **conditions).select("id")


QUERIES["tag_filter"] = _filtered(tag="SRC1")
QUERIES["tag_filter_wildcard"] = _filtered(tag="s_c1%")
QUERIES["tag_filter_spanning"] = _filtered(tag="en,src1")
QUERIES["status_filter"] = _filtered(status="sent")
QUERIES["type_filter"] = _filtered(doc_type="page")
QUERIES["after_filter"] = _filtered(after="2024-03-01")
QUERIES["before_filter"] = _filtered(before="2023-06-15")
QUERIES["filter_conjunction"] = _filtered(tag="fr", status="published", doc_type="post", after="2022-06-01", before="2025-01-01")


@query
def changed_since(spark, sf_dir):
    return filters.changed_since(testtables.archive(spark, sf_dir), WATERMARK).select("id", "updated_at")


@query
def empty_body(spark, sf_dir):
    return filters.empty_bodies(testtables.archive(spark, sf_dir)).select("id")


# --- joins ------------------------------------------------------------------------------------
@query
def index_documents_join(spark, sf_dir):
    index = index_for(spark, sf_dir)
    per_doc = index.postings.groupBy("id").agg(F.count("*").alias("n_postings"))
    return per_doc.join(index.documents, "id").select("id", "title", "n_postings")


@query
def term_lookup(spark, sf_dir):
    index = index_for(spark, sf_dir)
    found = matching.term_lookup(_slot_terms(spark, sf_dir), index.postings, index.buckets)
    found = found.select("clause_key", F.col("slot").cast("long").alias("slot"), "term", "id", "col", F.col("n_places").cast("long").alias("n_places"))
    return _named(spark, sf_dir, found)


@query
def phrase_match(spark, sf_dir):
    return _match_rows(spark, sf_dir, _phrases(spark, sf_dir))


@query
def not_match(spark, sf_dir):
    excluding = parsed_for(spark, sf_dir).clauses.where("negated").select("query_id").distinct()
    return _held(spark, sf_dir).join(excluding, "query_id", "left_semi").select("query_id", "id")


@query
def existing_id_probe(spark, sf_dir):
    return merging.split_batch(testtables.posts(spark, sf_dir), _batch(spark, sf_dir))


@query
def prune_join(spark, sf_dir):
    return merging.removed_count(testtables.archive(spark, sf_dir), _live(spark, sf_dir))


@query
def prefix_lookup(spark, sf_dir):
    index = index_for(spark, sf_dir)
    slots = matching.clause_slots(parsed_for(spark, sf_dir).clauses).where("as_prefix")
    return matching.widen_slots(slots, index.vocab, index.buckets).select("clause_key", F.col("slot").cast("long").alias("slot"), "term")


# --- aggregations -----------------------------------------------------------------------------
@query
def document_count(spark, sf_dir):
    return reports.document_count(testtables.archive(spark, sf_dir))


@query
def document_ids(spark, sf_dir):
    return reports.document_ids(testtables.archive(spark, sf_dir))


@query
def empty_body_count(spark, sf_dir):
    return reports.archive_health(testtables.archive(spark, sf_dir)).select("n_empty")


@query
def empty_body_alarm(spark, sf_dir):
    return reports.archive_health(testtables.archive(spark, sf_dir))


@query
def merge_counts(spark, sf_dir):
    return merging.merge_counts(testtables.posts(spark, sf_dir), _batch(spark, sf_dir))


@query
def type_counts(spark, sf_dir):
    return reports.type_counts(testtables.archive(spark, sf_dir))


@query
def status_report(spark, sf_dir):
    docs = testtables.archive(spark, sf_dir)
    state = docs.agg(F.max("updated_at").alias("value")).select(F.lit("last_sync_at").alias("key"), "value")
    return reports.status_report(docs, state, NOW)


@query
def stored_size(spark, sf_dir):
    """The size of a stored snapshot; how many bytes depends on the writer, so only their being there is compared."""
    stored = archive.write_documents(testtables.archive(spark, sf_dir), scratch_path(spark, "snapshot"))
    size = reports.stored_bytes(stored)
    return size.select((F.col("n_bytes") > 0).alias("has_bytes"), F.col("size").rlike("^[0-9.]+ (B|KB|MB)$").alias("is_readable")).crossJoin(
        reports.document_count(stored).select(F.col("n_docs"))
    )


@query
def document_frequency(spark, sf_dir):
    return _named(spark, sf_dir, matching.document_frequency(_matches(spark, sf_dir)))


@query
def corpus_statistics(spark, sf_dir):
    stats = indexing.corpus_stats(indexing.doc_lengths(testtables.archive(spark, sf_dir)))
    return stats.select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query
def and_match(spark, sf_dir):
    return _held(spark, sf_dir).select("query_id", "id")


@query
def hit_count(spark, sf_dir):
    return reports.hit_counts(testtables.search_log(spark, sf_dir), hits_for(spark, sf_dir))


# --- order and limit --------------------------------------------------------------------------
@query
def newest_first(spark, sf_dir):
    return ranking.newest_first(testtables.archive(spark, sf_dir), ranking.DEFAULT_LIMIT).select("id", "published_at", "updated_at")


@query
def best_first(spark, sf_dir):
    return hits_for(spark, sf_dir).where("score < 0").select("query_id", "rank", "id")


@query
def default_limit(spark, sf_dir):
    hits = searching.search_batch(index_for(spark, sf_dir), testtables.search_log(spark, sf_dir), limit=-1)
    return hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))


# --- set operations ---------------------------------------------------------------------------
@query
def live_ids(spark, sf_dir):
    return _live(spark, sf_dir)


@query
def stale_ids(spark, sf_dir):
    return merging.stale_ids(testtables.archive(spark, sf_dir), _live(spark, sf_dir))


# --- text analysis and search -----------------------------------------------------------------
def _posting_rows(postings: DataFrame) -> DataFrame:
    places = F.array_join(F.transform("positions", lambda p: p.cast("string")), ",")
    return postings.select("term", "id", "col", "weight", places.alias("positions"))


@query
def tokenize(spark, sf_dir):
    return indexing.tokenize(testtables.archive(spark, sf_dir)).select("id", "col", F.col("pos").cast("long").alias("pos"), "term")


@query
def stem_vocabulary(spark, sf_dir):
    return index_for(spark, sf_dir).vocab.select("term", "stem", "n_docs")


@query
def build_postings(spark, sf_dir):
    return _posting_rows(indexing.build_postings(testtables.archive(spark, sf_dir)))


@query
def doc_lengths(spark, sf_dir):
    return indexing.doc_lengths(testtables.archive(spark, sf_dir))


@query
def update_postings(spark, sf_dir):
    """The index of the posts, brought up to date with the batch."""
    before = indexing.build_postings(testtables.posts(spark, sf_dir))
    changed = merging.last_records(_batch(spark, sf_dir), ["seq"])
    return _posting_rows(indexing.update_postings(before, changed))


@query
def search_log_queries(spark, sf_dir):
    queries, _ = searchlog.search_log_clauses(testtables.search_log(spark, sf_dir))
    return queries.withColumn("n_positive", F.col("n_positive").cast("long"))


@query
def search_log_clauses(spark, sf_dir):
    _, clauses = searchlog.search_log_clauses(testtables.search_log(spark, sf_dir))
    return clauses.select(
        "query_id", F.col("clause_no").cast("long").alias("clause_no"), "negated", "title_only", "prefix", "text",
        F.array_join("terms", " ").alias("terms"),
    )


@query
def term_match(spark, sf_dir):
    return _match_rows(spark, sf_dir, _single_terms(spark, sf_dir))


@query
def title_scope(spark, sf_dir):
    return _match_rows(spark, sf_dir, _matches(spark, sf_dir, "title "))


@query
def prefix_last_term(spark, sf_dir):
    return _match_rows(spark, sf_dir, _matches(spark, sf_dir, "any prefix "))


@query
def bm25_topk(spark, sf_dir):
    return hits_for(spark, sf_dir).where("score < 0").select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query
def snippets(spark, sf_dir):
    return hits_for(spark, sf_dir).select("query_id", "id", "snippet")


@query
def highlight_bodies(spark, sf_dir):
    hits = highlight(hits_for(spark, sf_dir), testtables.search_log(spark, sf_dir), "<<", ">>")
    return hits.select("query_id", "id", "highlighted")


@query
def search_batch(spark, sf_dir):
    hits = searching.search_batch(index_for(spark, sf_dir), testtables.search_log(spark, sf_dir))
    return _flat(hits).withColumn("score", F.round("score", 6))


@query
def search_one(spark, sf_dir):
    hits = searching.search(index_for(spark, sf_dir), spark, "the that -tion after:2022")
    return hits.select("rank", "id", "title", "snippet", F.round("score", 6).alias("score"))


@query
def large_limit(spark, sf_dir):
    """Both routes with a limit above everything that Spark limits before a shuffle by itself."""
    log = testtables.search_log(spark, sf_dir)
    hits = searching.search_batch(index_for(spark, sf_dir), log, limit=5000)
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query
def no_text_route(spark, sf_dir):
    return hits_for(spark, sf_dir).where("score = 0").select("query_id", "rank", "id", "snippet")


# --- merge and change capture -----------------------------------------------------------------
@query
def merge_documents(spark, sf_dir):
    return _flat(merging.merge_documents(testtables.posts(spark, sf_dir), _batch(spark, sf_dir), ["seq"]))


@query
def plan_sync(spark, sf_dir):
    docs = testtables.archive(spark, sf_dir)
    runs = [("first", None, False), ("incremental", WATERMARK, False), ("full", WATERMARK, True)]
    plans = [sync.plan_sync(docs, mark, full).agg(F.count("*").alias("n_docs")).select(F.lit(name).alias("run"), "n_docs") for name, mark, full in runs]
    return plans[0].unionByName(plans[1]).unionByName(plans[2])


@query
def sync_archive(spark, sf_dir):
    """An incremental run with a prune: posts held, everything landed, the public part live."""
    held = testtables.posts(spark, sf_dir)
    pages = api_pages.read_all_types(spark, landed_for(spark, sf_dir))
    return sync.sync_archive(held, pages, SITE, WATERMARK, live_pages=pages.where("type = 'post'")).counts


@query
def watermark_advance(spark, sf_dir):
    """Two stored runs: the first takes everything, the second what changed after the first."""
    pages = api_pages.read_all_types(spark, landed_for(spark, sf_dir))
    root = scratch_path(spark, "synced")
    first = sync.run_sync(spark, pages, root, SITE, now=WATERMARK)
    second = sync.run_sync(spark, pages, root, SITE, now=NOW)
    state = archive.read_state(spark, f"{root}/state")
    docs = archive.read_archive(spark, root)
    counts = {f"{run}_{k}": v for run, c in (("first", first), ("second", second)) for k, v in c.items()}
    return docs.agg(F.count("*").alias("n_docs")).select(
        "n_docs", *(F.lit(v).cast("long").alias(k) for k, v in counts.items()),
        F.lit(archive.state_value(state, archive.LAST_SYNC)).alias("last_sync_at"),
    )


def _archive_state(spark, root: str, step: str) -> DataFrame:
    state = archive.read_state(spark, f"{root}/state")
    docs = archive.read_archive(spark, root)
    mark = F.lit(archive.state_value(state, archive.LAST_SYNC)).cast("string")
    return docs.agg(F.count("*").alias("n_docs")).select(F.lit(step).alias("step"), "n_docs", mark.alias("last_sync_at"))


@query
def incomplete_landing(spark, sf_dir):
    """A second run with a prune of which every other page has not landed: it fails and changes nothing."""
    pages = api_pages.read_all_types(spark, landed_for(spark, sf_dir))
    some, root = pages.where("page % 2 = 1"), scratch_path(spark, "synced")
    sync.run_sync(spark, pages, root, SITE, now=WATERMARK)
    steps = []
    for step, landed, live in (("landing", some, None), ("listing", pages, some)):
        try:
            sync.run_sync(spark, landed, root, SITE, full=True, live_pages=live, now=NOW)
            step = "no failure"
        except sync.IncompleteLanding:
            pass
        steps.append(_archive_state(spark, root, step))
    return steps[0].unionByName(steps[1])


@query
def page_wise_commit(spark, sf_dir):
    """Three page sets of which the second can't be read, then all three, twice."""
    pages = api_pages.read_all_types(spark, landed_for(spark, sf_dir))
    sets = [pages.where(F.col("page") % 3 == k) for k in (1, 2, 0)]
    broken = api_pages.parse_pages(spark.range(1).select(F.lit("<html>").alias("value")), "post")
    root = scratch_path(spark, "synced")
    try:
        sync.run_page_sets(spark, [sets[0], sets[1].unionByName(broken), sets[2]], root, SITE, now=WATERMARK)
        steps = [_archive_state(spark, root, "no failure")]
    except Exception:  # whatever Spark makes of a body that is no JSON
        steps = [_archive_state(spark, root, "broken")]
    for step, mark in (("whole", WATERMARK), ("again", NOW)):
        sync.run_page_sets(spark, sets, root, SITE, full=True, now=mark)
        steps.append(_archive_state(spark, root, step))
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


@query
def same_id_two_types(spark, sf_dir):
    """Pages landed under ids of posts: the later type stays."""
    root = scratch_path(spark, "landed")
    testtables.landed_pages(testtables.raw_json_posts(spark, sf_dir), "posts", root)
    renamed = F.col("record").withField("id", F.concat(F.lit("d"), F.col("n").cast("string")))
    testtables.landed_pages(testtables.raw_json_pages(spark, sf_dir).withColumn("record", renamed), "pages", root)
    nothing = spark.createDataFrame([], archive.DOCUMENT_SCHEMA)
    return sync.sync_archive(nothing, api_pages.read_all_types(spark, root), SITE).documents.select("id", "type")


@query
def prune(spark, sf_dir):
    return merging.prune(testtables.archive(spark, sf_dir), _live(spark, sf_dir)).select("id", "status")


# --- streaming --------------------------------------------------------------------------------
def _take_in(spark: SparkSession, sf_dir: str, out: str) -> None:
    for doc_type in ("post", "page"):
        marks = scratch_path(spark, "feed-marks")
        feed.stream_archive(spark, f"{landed_for(spark, sf_dir)}/{doc_type}s/*", out, marks, doc_type, SITE).awaitTermination()


def fed_for(spark: SparkSession, sf_dir: str) -> str:
    """All landed posts and pages taken in as a stream; returns the folder."""
    def make():
        out = scratch_path(spark, "feed")
        _take_in(spark, sf_dir, out)
        return out

    return _once("fed", spark, sf_dir, make)


@query
def stream_archive(spark, sf_dir):
    """The landed posts and pages as streams over an archive that holds four fifths of the posts."""
    held = testtables.posts(spark, sf_dir).where(F.substring("id", -1, 1) < "8")
    return _flat(feed.current_documents(spark, fed_for(spark, sf_dir), held))


@query
def stream_postings(spark, sf_dir):
    return _posting_rows(feed.current_postings(spark, fed_for(spark, sf_dir)))


def _held_index(spark: SparkSession, sf_dir: str) -> ArchiveIndex:
    """An index of four fifths of the posts, before the landed posts and pages change it."""
    def make():
        held = testtables.posts(spark, sf_dir).where(F.substring("id", -1, 1) < "8")
        return build_index(spark, held, scratch_path(spark, "index"), INDEX_BUCKETS)

    return _once("held-index", spark, sf_dir, make)


@query
def search_after_feed(spark, sf_dir):
    """The search log over a stored index with landed changes that it doesn't hold yet."""
    index = feed.live_index(spark, _held_index(spark, sf_dir), fed_for(spark, sf_dir))
    hits = searching.search_batch(index, testtables.search_log(spark, sf_dir))
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"), "snippet")


@query
def compaction(spark, sf_dir):
    """The changes folded into a new stored index."""
    index = feed.compact(spark, _held_index(spark, sf_dir), fed_for(spark, sf_dir), scratch_path(spark, "index"))
    return _posting_rows(index.postings)


def pruned_feed_for(spark: SparkSession, sf_dir: str) -> str:
    """All landed posts and pages taken in, then everything deleted that is no longer live."""
    def make():
        out = scratch_path(spark, "feed")
        _take_in(spark, sf_dir, out)
        feed.prune_feed(spark, out, _live(spark, sf_dir), _held_index(spark, sf_dir).documents)
        return out

    return _once("pruned-feed", spark, sf_dir, make)


@query
def search_after_prune(spark, sf_dir):
    """The search log over a stored index with landed changes and deletions that it doesn't hold yet."""
    index = feed.live_index(spark, _held_index(spark, sf_dir), pruned_feed_for(spark, sf_dir))
    hits = searching.search_batch(index, testtables.search_log(spark, sf_dir))
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"), "snippet")


@query
def stream_prune(spark, sf_dir):
    """The documents left by the feed and its deletions over an archive of four fifths of the posts."""
    held = testtables.posts(spark, sf_dir).where(F.substring("id", -1, 1) < "8")
    return _flat(feed.current_documents(spark, pruned_feed_for(spark, sf_dir), held))


@query
def out_of_order_guard(spark, sf_dir):
    """Landed posts and pages over an archive whose posts with a label and pages with an odd number are newer."""
    labels = testtables.table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit(True).alias("newer"))
    odd_page = (F.col("type") == "page") & F.substring("id", -1, 1).isin("1", "3", "5", "7", "9")
    held = testtables.archive(spark, sf_dir).join(labels, "id", "left").withColumns({
        "title": F.lit("held"),
        "updated_at": F.when(F.col("newer") | odd_page, F.concat(F.lit("9"), "updated_at")).otherwise(F.col("updated_at")),
    }).drop("newer")
    return feed.current_documents(spark, fed_for(spark, sf_dir), held).select("id", "title", "updated_at")


@query
def stream_search(spark, sf_dir):
    source, out, marks = (scratch_path(spark, name) for name in ("typed", "answers", "answer-marks"))
    testtables.search_log(spark, sf_dir).select("query_id", "raw").write.json(source)
    livesearch.stream_search(spark, index_for(spark, sf_dir), source, out, marks).awaitTermination()
    answers = spark.read.parquet(out)
    return answers.select("query_id", "rank", "id", F.round("score", 6).alias("score"))
