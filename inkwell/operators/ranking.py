"""Scores and top hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the ranking function.
BM25_K1 = 1.2
BM25_B = 0.75
MIN_IDF = 1e-6
# Fixed value: hits per query where nothing else is asked for.
DEFAULT_LIMIT = 50


def effective_limit(limit: int | None) -> int:
    """A missing or non-positive limit is the default one."""
    return limit if limit is not None and limit > 0 else DEFAULT_LIMIT


def inverse_frequency(n_docs: Column, corpus_docs: int) -> Column:
    """The floor decides the order in small archives, where common terms would count negative."""
    idf = F.log((F.lit(corpus_docs) - n_docs + F.lit(0.5)) / (n_docs + F.lit(0.5)))
    return F.when(idf <= 0.0, F.lit(MIN_IDF)).otherwise(idf)


def bm25(parts: Column, n_tokens: Column, avg_len: float) -> Column:
    """Negative, better is smaller. Summed in clause order, so that equal documents get
    bit-equal scores and ties fall to the id."""
    norm = F.lit(BM25_K1) * (F.lit(1.0 - BM25_B) + F.lit(BM25_B) * n_tokens / F.lit(float(avg_len)))
    return -F.aggregate(
        parts,
        F.lit(0.0),
        lambda total, p: total + p["idf"] * ((p["freq"] * F.lit(BM25_K1 + 1.0)) / (p["freq"] + norm)),
    )


def top_rows(rows: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
    """The first `limit` rows of every group, with their `rank`.

    Each group is cut within every input partition first, so that a group of any size meets in
    one task as at most `limit` rows a partition, whatever the limit is.
    """
    parts = rows.withColumn("_part", F.spark_partition_id())
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    cut = parts.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= limit).drop("_n", "_part")
    over_all = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn("rank", F.row_number().over(over_all)).where(F.col("rank") <= limit)


def best_first(scored: DataFrame, limit: int) -> DataFrame:
    """Ranks per query."""
    return top_rows(scored, ["query_id"], [F.col("score"), F.col("id")], limit)


def newest_order() -> list[Column]:
    return [F.col("published_at").desc(), F.col("updated_at").desc(), F.col("id")]


def newest_first(docs: DataFrame, limit: int) -> DataFrame:
    """T1 for one search: no text, newest documents first, undated ones last."""
    return docs.orderBy(*newest_order()).limit(limit)


def tag_sets_by_value(csvs: DataFrame, values: DataFrame) -> DataFrame:
    """F1 for a log: which distinct tag lists satisfy which tag filters.

    The literal head of the filter value (up to the first wildcard or comma) must start one of
    the tags, so tags are listed under the head lengths in use and joined by equality; the full
    rule then decides.
    """
    from inkwell.operators.filters import tag_match

    headed = values.select("tag", F.lower(F.regexp_extract("tag", "^[^%_,]*", 0)).alias("head"))
    lengths = headed.agg(F.collect_set(F.char_length("head")).alias("n")).scalar()
    listed = (
        csvs.select("tags_csv", lengths.alias("lengths"))
        .select("tags_csv", "lengths", F.explode_outer(F.split(F.lower("tags_csv"), ",")).alias("one"))
        .select("tags_csv", "one", F.explode_outer("lengths").alias("n"))
        .where(F.col("n") <= F.char_length("one"))
        .select("tags_csv", F.substring(F.col("one"), F.lit(1), F.col("n")).alias("head"))
        .distinct()
    )
    return (
        listed.join(headed, "head")
        .where(tag_match(F.col("tags_csv"), F.col("tag")))
        .select("tags_csv", "tag")
        .distinct()
    )


def newest_first_batch(docs: DataFrame, queries: DataFrame, limit: int, with_tags: bool = True) -> DataFrame:
    """X15, T1 for a log: per query the newest documents that pass its filters.

    Queries never meet documents pair by pair. A document is listed under the (status, type,
    tag) combinations in use, each with "any" as a value, and per combination and day only the
    newest `limit` are kept. Date bounds are whole days, so a day is wholly inside or outside a
    query and nothing that could be a hit is lost. Queries then read those short lists.
    """
    facets = ("status", "type", "tag")
    spec = F.to_json(F.struct(*facets, "before", "after"), {"ignoreNullFields": "false"})
    facet = F.to_json(F.struct(*facets), {"ignoreNullFields": "false"})
    keyed = queries.withColumn("spec", spec)
    specs = keyed.select(*facets, "before", "after", "spec").dropDuplicates(["spec"]).withColumn("facet", facet)

    slim = docs.select(
        "id", "status", "type", "published_at", "updated_at", F.array_join("tags", ",").alias("tags_csv")
    )
    untagged = slim.withColumn("tag", F.lit(None).cast("string"))
    either = lambda name: F.explode(F.array(F.col(name), F.lit(None).cast("string"))).alias(name)
    if with_tags:
        tag_values = specs.where(F.col("tag").isNotNull()).select("tag").distinct()
        tag_sets = tag_sets_by_value(slim.select("tags_csv").distinct(), tag_values)
        untagged = untagged.unionByName(slim.join(tag_sets, "tags_csv"))
    listed = (
        untagged.select("id", "published_at", "updated_at", "type", "tag", either("status"))
        .select("id", "published_at", "updated_at", "tag", "status", either("type"))
        .withColumn("facet", facet)
        .join(specs.select("facet").distinct(), "facet", "left_semi")
        .withColumn("day", F.substring("published_at", 1, 10))
    )
    short = top_rows(listed, ["facet", "day"], newest_order(), limit).select(
        "facet", "day", "id", "published_at", "updated_at"
    )
    inside = (F.col("after").isNull() | F.coalesce(F.col("day") >= F.col("after"), F.lit(False))) & (
        F.col("before").isNull() | F.coalesce(F.col("day") < F.col("before"), F.lit(False))
    )
    read = short.join(specs.select("facet", "spec", "before", "after"), "facet").where(inside)
    ranked = top_rows(read, ["spec"], newest_order(), limit).select("spec", "id", "rank")
    return keyed.select("query_id", "spec").join(ranked, "spec").select("query_id", "id", "rank")
