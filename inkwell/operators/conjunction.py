"""The documents that hold all clauses of a query, beginning with its rarest clause.

Postings of a common word are never gathered as such: the rarest clause of a query gives its candidates, its filters
cut them at once, and of all other clauses only postings that meet a candidate are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.filters import query_filters_hold
from inkwell.operators.matching import document_frequency, term_lookup


def clause_counts(slot_terms: DataFrame, whole: DataFrame | None) -> DataFrame:
    """`(clause_key, n_docs, cost)`: documents of every clause that has any, and the rows that reading it takes.

    Plain words are counted in the vocabulary. `whole` are the matches of all other clauses.
    """
    own = F.when(F.col("title_only"), F.col("stem_title_docs")).otherwise(F.col("stem_docs"))
    plain = slot_terms.where("plain").groupBy("clause_key").agg(F.max(own).alias("n_docs"), F.sum("n_docs").alias("cost"))
    plain = plain.where("n_docs > 0")
    if whole is None:
        return plain
    return plain.unionByName(document_frequency(whole).withColumn("cost", F.col("n_docs")))


def ranked_clauses(clauses: DataFrame, counts: DataFrame) -> DataFrame:
    """The clauses that decide, with `n_docs`, whether they are `plain`, and whether they lead their query.

    A query with a positive clause that nothing matches has no hits and is left out, as are exclusions that exclude
    nothing. The leading clause is the positive one with the least cost; `n_others` counts the rest.
    """
    known = clauses.select(
        "query_id", "clause_no", "negated", "clause_key", ((F.size("terms") == 1) & ~F.col("prefix")).alias("plain")
    ).join(counts, "clause_key", "left")
    query = Window.partitionBy("query_id")
    alive = known.withColumn("dead", F.max(~F.col("negated") & F.col("n_docs").isNull()).over(query))
    alive = alive.where(~F.col("dead") & F.col("n_docs").isNotNull()).drop("dead")
    turn = F.row_number().over(query.orderBy("negated", "cost", "clause_no"))
    return alive.withColumns({
        "leads": turn == 1, "n_others": F.count("*").over(query) - 1, "n_positive": F.count_if(~F.col("negated")).over(query),
    })


def _plain_rows(slot_terms: DataFrame, postings: DataFrame, buckets: int, clauses: DataFrame, *facts: str) -> DataFrame:
    """Postings of the plain clauses named in `clauses`, one weighted frequency each."""
    wanted = slot_terms.where("plain").join(clauses.select("clause_key").distinct(), "clause_key", "left_semi")
    return term_lookup(wanted, postings, buckets).select(
        "clause_key", "id", *facts, (F.col("weight") * F.col("n_places")).alias("freq")
    )


FACTS = ("n_tokens", "type", "status", "tags_csv", "published_at")


def candidates(
    slot_terms: DataFrame, postings: DataFrame, buckets: int, whole: DataFrame | None, leading: DataFrame
) -> DataFrame:
    """Rows of the leading clauses that pass the filters of their queries: `leading` has the filters as `q`."""
    rows = _plain_rows(slot_terms, postings, buckets, leading.where("plain"), *FACTS)
    if whole is not None:
        rows = rows.unionByName(whole.select("clause_key", "id", *FACTS, "freq"))
    return (
        rows.join(leading, "clause_key")
        .where(query_filters_hold(F.col("tags_csv")))
        .select("query_id", "id", "clause_no", "negated", "n_docs", "freq", "n_tokens", "n_positive")
    )


def wanted_pairs(found: DataFrame, others: DataFrame) -> DataFrame:
    """Which clauses are still to be looked up in which documents."""
    return found.select("query_id", "id").distinct().join(
        others.select("query_id", "clause_no", "negated", "n_docs", "clause_key", "plain"), "query_id"
    )


def other_rows(slot_terms: DataFrame, postings: DataFrame, buckets: int, whole: DataFrame | None, pairs: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of the other clauses, cut to the settled `pairs` where they are read."""
    rows = _plain_rows(slot_terms, postings, buckets, others.where("plain"))
    if whole is not None:
        rows = rows.unionByName(whole.select("clause_key", "id", "freq"))
    nothing = F.lit(None).cast("long")
    return rows.join(pairs, ["clause_key", "id"]).select(
        "query_id", "id", "clause_no", "negated", "n_docs", "freq", nothing.alias("n_tokens"), nothing.alias("n_positive")
    )


def conjunction(rows: DataFrame, parts: Column) -> DataFrame:
    """`(query_id, id, n_tokens, parts)` of the documents that hold every positive clause and no negated one.

    One shuffle by query and document. `parts` is collected over the positive clauses in clause order.
    """
    by_clause = rows.repartition("query_id", "id").groupBy("query_id", "id", "clause_no", "negated", "n_docs").agg(
        F.sum("freq").alias("freq"), F.max("n_tokens").alias("n_tokens"), F.max("n_positive").cast("long").alias("n_positive")
    )
    held = by_clause.groupBy("query_id", "id").agg(
        F.max("n_tokens").alias("n_tokens"), F.max("n_positive").alias("n_positive"),
        F.count_if(~F.col("negated")).alias("n_held"), F.max("negated").alias("excluded"),
        F.sort_array(F.collect_list(F.when(~F.col("negated"), parts))).alias("parts"),
    )
    return held.where((F.col("n_held") == F.col("n_positive")) & ~F.col("excluded")).drop("n_held", "n_positive", "excluded")
