"""F1-F8: predicates over documents, for constants and for the rows of a search log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_match(csv: Column, value: Column) -> Column:
    """a whole slug in the comma list, ASCII case-insensitive; % and _ are wildcards.

    The backslash is an escape sign for ilike but an ordinary character here, so it is doubled.
    """
    plain = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    listed = F.concat(F.lit(","), csv, F.lit(","))
    return F.ilike(listed, F.concat(F.lit("%,"), plain, F.lit(",%")))


def published_from(published_at: Column, bound: Column) -> Column:
    """text comparison; a document without a date never qualifies."""
    return published_at.isNotNull() & (published_at >= bound)


def published_until(published_at: Column, bound: Column) -> Column:
    """F5."""
    return published_at.isNotNull() & (published_at < bound)


def filter_documents(
    docs: DataFrame,
    tag: str | None = None,
    status: str | None = None,
    doc_type: str | None = None,
    after: str | None = None,
    before: str | None = None,
) -> DataFrame:
    """F6 for constants: every given filter must hold. Plain comparisons reach the scan."""
    if status is not None:
        docs = docs.where(F.col("status") == status)
    if doc_type is not None:
        docs = docs.where(F.col("type") == doc_type)
    if after is not None:
        docs = docs.where(published_from(F.col("published_at"), F.lit(after)))
    if before is not None:
        docs = docs.where(published_until(F.col("published_at"), F.lit(before)))
    if tag is not None:
        docs = docs.where(tag_match(F.array_join("tags", ","), F.lit(tag)))
    return docs


def query_filters_hold(tags_csv: Column, query: str = "q") -> Column:
    """F6 for a joined row of a search log: an absent filter always holds.

    Document columns are `status`, `type`, `published_at`; the filters are fields of the struct
    column `query`.
    """
    f = lambda name: F.col(f"{query}.{name}")
    published = F.col("published_at")
    return (
        (f("status").isNull() | (f("status") == F.col("status")))
        & (f("type").isNull() | (f("type") == F.col("type")))
        & (f("after").isNull() | F.coalesce(published >= f("after"), F.lit(False)))
        & (f("before").isNull() | F.coalesce(published < f("before"), F.lit(False)))
        & (f("tag").isNull() | tag_match(tags_csv, f("tag")))
    )


def changed_since(docs: DataFrame, watermark: str | None) -> DataFrame:
    """strictly newer than the watermark; everything where there is none yet."""
    return docs if watermark is None else docs.where(F.col("updated_at") > watermark)


def empty_bodies(docs: DataFrame) -> DataFrame:
    """F8."""
    return docs.where(F.col("plaintext") == "")
