"""Landed API response pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.fields import DOC_TYPES, variant_string


def parse_pages(pages: DataFrame, doc_type: str) -> DataFrame:
    """Text column `value`, one response body per row -> one row per landed page.

    A body that is not JSON, or is a bare scalar or null, fails the load. A body without an
    array under the collection name has no documents.
    """
    body = F.parse_json(F.col("value"))
    kind = F.schema_of_variant(F.col("body"))
    readable = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    checked = F.when(readable, F.lit(True)).otherwise(
        F.raise_error(F.lit("unreadable page: the body is neither an object nor an array"))
    )
    items = F.try_variant_get(F.col("body"), f"$.{doc_type}s", "array<variant>")
    return (
        pages.withColumn("body", body)
        .where(checked)
        .select(
            F.lit(doc_type).alias("type"),
            _number("$.meta.pagination.page").alias("page"),
            _number("$.meta.pagination.pages").alias("pages"),
            _number("$.meta.pagination.total").alias("total"),
            F.coalesce(items, F.array().cast("array<variant>")).alias("items"),
        )
    )


def _number(path: str) -> Column:
    """A JSON number, or null for a missing field or another type."""
    kind = F.schema_of_variant(F.try_variant_get(F.col("body"), path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(F.col("body"), path, "long"))


def read_pages(spark: SparkSession, path: str, doc_type: str, per_line: bool = False) -> DataFrame:
    """Landed pages: one response body per file, or one per line where `per_line` is set.

    A fetcher that lands many pages should write them per line: such files are splittable and
    do not put one small file per hundred documents on the storage.
    """
    return parse_pages(spark.read.text(path, wholetext=not per_line), doc_type)


def page_documents(pages: DataFrame) -> DataFrame:
    """One row per raw record, with its place in the page (order matters for repeated ids)."""
    return pages.select("type", "page", F.posexplode("items").alias("item", "doc"))


def read_api_pages(spark: SparkSession, path: str, doc_type: str, per_line: bool = False) -> DataFrame:
    """S1."""
    return page_documents(read_pages(spark, path, doc_type, per_line))


def page_coverage(pages: DataFrame) -> DataFrame:
    """Which pages arrived per type, which are missing, and the announced total.

    The highest page seen decides how many there are (default and least 1); the total defaults
    to the documents at hand.
    """
    seen = pages.withColumn("page", F.coalesce("page", F.lit(1))).groupBy("type").agg(
        F.greatest(F.coalesce(F.max_by("pages", "page"), F.lit(1)), F.lit(1)).alias("pages"),
        F.max_by("total", "page").alias("announced"),
        F.sum(F.size("items")).cast("long").alias("n_docs"),
    )
    arrived = pages.select("type", F.coalesce("page", F.lit(1)).alias("page")).distinct()
    expected = seen.select("type", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))
    absent = expected.join(arrived, ["type", "page"], "left_anti")
    missing = absent.groupBy("type").agg(F.count("*").alias("n_missing"))
    return seen.join(missing, "type", "left").select(
        "type",
        "pages",
        F.coalesce("announced", "n_docs").alias("total"),
        "n_docs",
        F.coalesce("n_missing", F.lit(0)).alias("n_missing"),
    )


def missing_pages(pages: DataFrame) -> DataFrame:
    """S2, the page numbers still to be fetched."""
    numbered = pages.withColumn("page", F.coalesce("page", F.lit(1)))
    last = numbered.groupBy("type").agg(F.coalesce(F.max_by("pages", "page"), F.lit(1)).alias("pages"))
    expected = last.select("type", F.explode(F.sequence(F.lit(1), F.greatest("pages", F.lit(1)))).alias("page"))
    return expected.join(numbered, ["type", "page"], "left_anti")


def read_ids(documents: DataFrame) -> DataFrame:
    """S3: ids and change times only, as the prune pass needs them. A record without an id fails
    the listing: what it stands for must not be pruned."""
    has_id = F.when(variant_string(F.col("doc"), "$.id").isNotNull(), F.lit(True)).otherwise(
        F.raise_error(F.lit("a listed record has no id"))
    )
    return documents.where(has_id).select(
        variant_string(F.col("doc"), "$.id").alias("id"),
        F.coalesce(variant_string(F.col("doc"), "$.updated_at"), F.lit("")).alias("updated_at"),
    )


def read_all_types(spark: SparkSession, root: str, per_line: bool = False) -> DataFrame:
    """Pages of every type below `root`, in folders named after the collections."""
    first, *rest = (read_pages(spark, f"{root}/{t}s", t, per_line) for t in DOC_TYPES)
    for pages in rest:
        first = first.unionByName(pages)
    return first
