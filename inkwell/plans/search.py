"""Whole search logs, and one search as a log of one row."""

from __future__ import annotations

import operator
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.fields import DOCUMENT_COLUMNS, excerpt, tags_to_csv
from inkwell.operators import conjunction
from inkwell.operators.indexing import DOC_FACTS, bucket_of
from inkwell.operators.matching import (
    clause_slots,
    match_clauses,
    phrase_candidates,
    phrase_seeds,
    sent_if_few,
    widen_slots,
    with_clause_key,
)
from inkwell.operators.ranking import (
    best_first,
    bm25,
    effective_limit,
    inverse_frequency,
    newest_first_batch,
)
from inkwell.operators.searchlog import FILTERS, clauses_of, parse_log, queries_of
from inkwell.operators.snippets import clause_instances, clause_slot_lists, snippets, text_columns
from inkwell.plans.index import ArchiveIndex
from inkwell.session import settle

# Values that reach a scan as such; with more of them the scan is joined.
PUSHED = 64
HIT_COLUMNS = ("query_id", "rank", *DOCUMENT_COLUMNS, "snippet", "score")


def _digest(text: Column) -> Column:
    """Sixteen bytes of a SHA-256: keys that keep rows small however long a search string is."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def distinct_queries(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with a query key, and each different query once under that key."""
    typed = F.coalesce("prefix_last", F.lit(False))
    keyed = log.withColumn("query_key", _digest(F.concat(F.when(typed, "typed ").otherwise("whole "), "raw")))
    once = keyed.select(F.col("query_key").alias("query_id"), "raw", typed.alias("prefix_last")).dropDuplicates(["query_id"])
    return keyed.select("query_id", "query_key"), once


@dataclass(frozen=True)
class ParsedLog:
    """A parsed log with what plans need to know about it beforehand."""

    queries: DataFrame
    clauses: DataFrame
    has_text: bool
    has_no_text: bool
    has_prefix: bool
    has_phrases: bool
    has_tags: bool
    # One search string: what follows from the string alone is part of the plan and nothing is written for it.
    single: bool = False


def read_log(once: DataFrame) -> ParsedLog:
    """Parse each different search string once and settle the result.

    Two aggregates over the settled rows tell which kinds of search occur, so that a plan has
    no branch for kinds that do not.
    """
    parsed = settle(parse_log(once), "parsed-log")
    queries, clauses = queries_of(parsed), with_clause_key(clauses_of(parsed))
    by_query = queries.agg(
        F.max(F.col("n_positive") > 0).alias("has_text"),
        F.max(F.col("n_positive") == 0).alias("has_no_text"),
        F.max(F.col("tag").isNotNull() & (F.col("n_positive") == 0)).alias("has_tags"),
    )
    by_clause = clauses.agg(
        F.max("prefix").alias("has_prefix"), F.max(F.size("terms") > 1).alias("has_phrases")
    )
    # One row each.
    known = by_query.crossJoin(by_clause).first()
    return ParsedLog(queries, clauses, **{name: bool(known[name]) for name in known.asDict()})


def read_string(once: DataFrame) -> ParsedLog:
    """`read_log` for one search string: what follows from the string alone stays part of the plan."""
    spark, parsed = once.sparkSession, parse_log(once)
    of_query = queries_of(parsed)
    queries, clauses = of_query.toArrow(), with_clause_key(clauses_of(parsed))
    rows = clauses.toArrow()
    positive = queries["n_positive"][0].as_py() if queries.num_rows else 0
    return ParsedLog(
        spark.createDataFrame(queries, of_query.schema), spark.createDataFrame(rows, clauses.schema),
        has_text=positive > 0, has_no_text=positive == 0, has_prefix=any(rows["prefix"].to_pylist()),
        has_phrases=any(len(t) > 1 for t in rows["terms"].to_pylist()), has_tags=bool(queries.num_rows and queries["tag"][0].is_valid), single=True,
    )


def _numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """`(key, number)`, written once: rows of matches carry the number, which takes a small part of the room of a digest."""
    return settle(rows.select(key).distinct().withColumn("number", F.monotonically_increasing_id()), name)


def with_clause_numbers(log: ParsedLog) -> tuple[ParsedLog, DataFrame]:
    """The log with numbers as clause keys, and the `(clause_key, number)` of each."""
    numbers = _numbered(log.clauses, "clause_key", "clause-numbers")
    clauses = log.clauses.join(numbers, "clause_key").withColumn("clause_key", F.col("number")).select(*log.clauses.columns)
    return replace(log, clauses=settle(clauses, "clauses")), numbers


def _among(df: DataFrame, bucket: str, key: str, values: list[tuple[int, str]]) -> DataFrame:
    """Rows with given (bucket, key) values. As plain comparisons they reach the scan, which skips the folders of
    other buckets, and of their files the row groups and pages that hold none of the values."""
    if not values:
        return df.where(F.lit(False))
    return df.where(F.col(bucket).isin(sorted({b for b, _ in values})) & reduce(operator.or_, [F.col(key) == v for _, v in values]))


def clause_terms(index: ArchiveIndex, log: ParsedLog) -> DataFrame:
    """The terms of the archive that the clauses of a log stand for."""
    return _clause_terms(index, log)[0]


def _clause_terms(index: ArchiveIndex, log: ParsedLog) -> tuple[DataFrame, list[tuple[int, str]] | None]:
    """The terms, and their (bucket, term) values if they are few enough to reach the scans as such."""
    if not log.single:
        slots = settle(clause_slots(log.clauses), "slots")
        return settle(widen_slots(slots, index.vocab, index.buckets, log.has_prefix), "slot-terms"), None
    slots = clause_slots(log.clauses).withColumn("bucket", bucket_of(F.col("stem"), index.buckets))
    held = slots.toArrow()
    rows = held.to_pylist()
    stems = sorted({(r["bucket"], r["stem"]) for r in rows if not r["as_prefix"]})
    vocab = _among(index.vocab, "stem_bucket", "stem", stems) if len(stems) <= PUSHED else index.vocab
    prefixes = {r["stem"] for r in rows if r["as_prefix"]}
    prefixed = index.vocab.where(F.col("stem").startswith(*prefixes)) if len(prefixes) == 1 else None
    own = index.vocab.sparkSession.createDataFrame(held, slots.schema).drop("bucket")
    found = widen_slots(own, vocab, index.buckets, log.has_prefix, prefixed).withColumn("bucket", bucket_of(F.col("term"), index.buckets))
    first = found.limit(PUSHED + 1).toArrow()
    if first.num_rows > PUSHED:
        return settle(found.drop("bucket"), "slot-terms"), None
    values = sorted({(r["bucket"], r["term"]) for r in first.to_pylist()})
    return own.sparkSession.createDataFrame(first, found.schema).drop("bucket"), values


def document_facts(documents: DataFrame) -> DataFrame:
    """What scores and filters read of a document, by id."""
    return documents.withColumn("tags_csv", tags_to_csv(F.col("tags"))).select("id", *DOC_FACTS)


def clause_matches(index: ArchiveIndex, log: ParsedLog, slot_terms: DataFrame, with_facts: bool = True) -> DataFrame:
    """All documents of each clause."""
    seen = None
    if log.has_phrases:
        seeds = settle(phrase_seeds(slot_terms, index.postings, index.buckets), "seeds")
        seen = settle(phrase_candidates(slot_terms, index.postings, index.buckets, seeds), "candidates")
    facts = document_facts(index.documents) if with_facts else None
    return match_clauses(slot_terms, index.postings, index.buckets, seen, facts)


def held_documents(index: ArchiveIndex, log: ParsedLog, slot_terms: DataFrame, with_filters: bool = True) -> DataFrame:
    """`(query_id, id, n_tokens, parts)` of the documents that hold all clauses of each query.

    Phrases and prefixes are matched first, since only that tells how many documents have them. Then every query
    follows its rarest clause.
    """
    whole = None
    if log.has_phrases or log.has_prefix:
        whole = settle(clause_matches(index, log, slot_terms.where(~F.col("plain"))), "whole-clauses")
    counts = conjunction.clause_counts(slot_terms, whole)
    clauses, n_others = _ranked(log, counts)
    filters = [F.col(f) if with_filters else F.lit(None).cast("string").alias(f) for f in FILTERS]
    leading = clauses.where("leads").join(log.queries.select("query_id", F.struct(*filters).alias("q")), "query_id")
    found = conjunction.candidates(slot_terms, index.postings, index.buckets, whole, leading)
    others = clauses.where(~F.col("leads"))
    if not n_others:
        return conjunction.conjunction(found, _parts(index))
    alone = F.col("n_others") == 0
    single = conjunction.candidates(slot_terms, index.postings, index.buckets, whole, leading.where(alone))
    several = settle(conjunction.candidates(slot_terms, index.postings, index.buckets, whole, leading.where(~alone)), "found")
    pairs = settle(conjunction.wanted_pairs(several, others), "pairs")
    more = conjunction.other_rows(slot_terms, index.postings, index.buckets, whole, pairs, others)
    return conjunction.conjunction(single.unionByName(several).unionByName(more), _parts(index))


def _ranked(log: ParsedLog, counts: DataFrame) -> tuple[DataFrame, int]:
    """The clauses that decide, and how many of them don't lead their query."""
    ranked = conjunction.ranked_clauses(log.clauses, counts)
    if log.single:
        rows = ranked.toArrow()
        return log.clauses.sparkSession.createDataFrame(rows, ranked.schema), rows["leads"].to_pylist().count(False)
    clauses = settle(ranked, "ranked-clauses")
    return clauses, clauses.where(~F.col("leads")).count()


def _parts(index: ArchiveIndex) -> Column:
    return F.struct("clause_no", "freq", inverse_frequency(F.col("n_docs"), index.n_docs).alias("idf"))


def text_hits(index: ArchiveIndex, log: ParsedLog, slot_terms: DataFrame, limit: int) -> DataFrame:
    """Scored top hits of the queries that have a positive clause."""
    held = held_documents(index, log, slot_terms)
    scored = held.select("query_id", "id", bm25(F.col("parts"), F.col("n_tokens"), index.avg_len).alias("score"))
    return best_first(scored, limit).select("query_id", "id", "rank", "score")


def date_hits(index: ArchiveIndex, log: ParsedLog, limit: int) -> DataFrame:
    """Top hits of the queries without a positive clause."""
    queries = log.queries.where("n_positive = 0")
    return newest_first_batch(index.documents, queries, limit, log.has_tags).select(
        "query_id", "id", "rank", F.lit(0.0).alias("score")
    )


def _with_documents(index: ArchiveIndex, hits: DataFrame, values: list[tuple[int, str]] | None) -> DataFrame:
    """Whole documents for held hits, by one scan of the bodies.

    The ids of a few hits reach the scan as values; the id buckets of others prune the stored folders.
    """
    placed = hits.where(F.col("rank") > 0).withColumn("id_bucket", bucket_of(F.col("id"), index.buckets))
    documents = index.documents.select("id_bucket", *DOCUMENT_COLUMNS)
    if values is not None:
        documents = _among(documents, "id_bucket", "id", values)
    else:
        documents = documents.join(sent_if_few(placed.select("id_bucket", "id").distinct()), ["id_bucket", "id"], "left_semi")
    return placed.join(documents, ["id_bucket", "id"])


def search_batch(index: ArchiveIndex, log: DataFrame, limit: int | None = None) -> DataFrame:
    """The hits of every row of a search log (`query_id`, `raw`, `prefix_last`).

    Equal search strings are searched once. Only top hits meet document bodies.
    """
    return _search(index, log, effective_limit(limit), single=False)


def _search(index: ArchiveIndex, log: DataFrame, k: int, single: bool) -> DataFrame:
    log_keys, once = distinct_queries(log)
    if single:
        parsed = read_string(once)
        parsed = replace(parsed, clauses=parsed.clauses.withColumn("clause_key", _digest(F.col("clause_key"))))
    else:
        numbers = _numbered(once, "query_id", "query-numbers")
        once = once.join(numbers, "query_id").select(F.col("number").alias("query_id"), "raw", "prefix_last")
        log_keys = log_keys.join(numbers.withColumnRenamed("query_id", "query_key"), "query_key")
        log_keys = log_keys.select("query_id", F.col("number").alias("query_key"))
        parsed, _ = with_clause_numbers(read_log(once))
    slot_terms, terms, searched = None, None, index
    if parsed.has_text:
        slot_terms, terms = _clause_terms(index, parsed)
        if terms is not None:
            searched = replace(index, postings=_among(index.postings, "term_bucket", "term", terms))
    routes = []
    if parsed.has_text:
        routes.append(text_hits(searched, parsed, slot_terms, k))
    if parsed.has_no_text or not routes:
        routes.append(date_hits(index, parsed, k))
    top, ids = reduce(DataFrame.unionByName, routes).join(parsed.queries.select("query_id", "n_positive"), "query_id"), None
    if single and k <= PUSHED:
        top = top.withColumn("bucket", bucket_of(F.col("id"), index.buckets))
        rows = top.toArrow()
        ids = sorted({(r["bucket"], r["id"]) for r in rows.select(["bucket", "id"]).to_pylist()})
        top = log.sparkSession.createDataFrame(rows, top.schema).drop("bucket")
    else:
        top = settle(top, "top-hits")
    plain = excerpt(F.col("plaintext"))
    full = _with_documents(index, top, ids)
    if slot_terms is None:
        shown = full.withColumn("snippet", plain)
    else:
        marked = parsed.clauses.where("not negated and not title_only").select("query_id", "clause_no", "clause_key")
        wanted = marked.join(slot_terms.select("clause_key", "n_terms", "slot", "term"), "clause_key")
        # A query with a short prefix has very many terms: written first, so that the size of the lists is known.
        lists = clause_slot_lists(wanted) if terms is not None else settle(clause_slot_lists(wanted), "slot-lists")
        # Bodies are taken apart last: their words and gaps take many times their room, and no shuffle has to carry them.
        shown = snippets(clause_instances(text_columns(full.join(lists, "query_id", "left"))))
        shown = shown.withColumn("snippet", F.when(F.col("n_positive") == 0, plain).otherwise(F.col("snippet")))
    shown = shown.withColumnRenamed("query_id", "query_key").withColumn("rank", F.col("rank").cast("long"))
    return log_keys.join(shown, "query_key").select(*HIT_COLUMNS)


def search(index: ArchiveIndex, spark: SparkSession, text: str, limit: int | None = None, prefix_last: bool = False) -> DataFrame:
    """One search string.

    What follows from the string and the limit alone stays part of the plan; wanted words and hit ids reach the scans
    as values.
    """
    log = spark.createDataFrame(
        pa.table({"query_id": pa.array([0], pa.int64()), "raw": pa.array([text]), "prefix_last": pa.array([prefix_last])})
    )
    return _search(index, log, effective_limit(limit), single=True).drop("query_id")
