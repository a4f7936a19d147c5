"""Raw API records to documents, in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fields
from inkwell.functions.fields import variant_string


def _shape(raw: DataFrame, site: str, extra: tuple[str, ...] = ()) -> DataFrame:
    doc = F.col("doc")
    text = lambda name: variant_string(doc, f"$.{name}")
    return raw.select(
        text("id").alias("id"),
        F.col("type"),
        fields.clean_status(text("status")).alias("status"),
        fields.clean_title(text("title")).alias("title"),
        fields.clean_string(text("slug")).alias("slug"),
        text("url").alias("url"),
        fields.editor_link(site, F.col("type"), text("id")).alias("editor_url"),
        fields.clean_string(text("plaintext")).alias("plaintext"),
        fields.tag_slugs(doc).alias("tags"),
        text("published_at").alias("published_at"),
        fields.clean_string(text("updated_at")).alias("updated_at"),
        *extra,
    )


def normalize_documents(raw: DataFrame, site: str, keep_order: bool = False) -> DataFrame:
    """Clean every record; one without a string id fails the batch.

    The check sits in a filter: column pruning could drop it from a projection. With
    `keep_order` the place of the record (`page`, `item`) stays for last-record-wins.
    """
    has_id = F.when(variant_string(F.col("doc"), "$.id").isNotNull(), F.lit(True)).otherwise(
        F.raise_error(F.lit("a record has no id"))
    )
    return _shape(raw.where(has_id), site, ("page", "item") if keep_order else ())


def split_rejects(raw: DataFrame, site: str) -> tuple[DataFrame, DataFrame]:
    """P2, the lenient form: cleaned documents, and the records without a string id as JSON."""
    has_id = variant_string(F.col("doc"), "$.id").isNotNull()
    rejects = raw.where(~has_id).select("type", "page", "item", F.to_json("doc").alias("raw"))
    return _shape(raw.where(has_id), site), rejects
