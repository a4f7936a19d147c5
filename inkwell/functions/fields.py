"""Column expressions over the document model: cleaning defaults, links, dates, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the document model and its outputs.
DOC_TYPES = ("post", "page")
DOC_STATUSES = ("published", "draft", "scheduled", "sent")
PUBLIC_STATUSES = ("published", "sent")
UNTITLED = "(untitled)"
EDITOR_PATH = "/ghost/#/editor/"
EXCERPT_CHARS = 160
DOCUMENT_COLUMNS = (
    "id", "type", "status", "title", "slug", "url", "editor_url", "plaintext", "tags",
    "published_at", "updated_at",
)


def variant_string(value: Column, path: str) -> Column:
    """A JSON string field, or null: a wrong type takes the default, it is never cast."""
    field = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(value, path, "string"))


def clean_status(raw: Column) -> Column:
    """An unknown or missing status is a draft."""
    return F.when(raw.isin(*DOC_STATUSES), raw).otherwise("draft")


def clean_title(raw: Column) -> Column:
    """Missing or empty becomes the placeholder; blanks are kept."""
    return F.coalesce(F.nullif(raw, F.lit("")), F.lit(UNTITLED))


def clean_string(raw: Column) -> Column:
    """P5: a missing string is empty."""
    return F.coalesce(raw, F.lit(""))


def tag_slugs(doc: Column) -> Column:
    """The non-empty slugs of an array of tag objects; anything else has no tags."""
    tags = F.try_variant_get(doc, "$.tags", "array<variant>")
    slugs = F.transform(tags, lambda tag: F.coalesce(variant_string(tag, "$.slug"), F.lit("")))
    return F.coalesce(F.filter(slugs, lambda slug: slug != ""), F.array().cast("array<string>"))


def editor_link(site: str, doc_type: Column, doc_id: Column) -> Column:
    """The editor address; trailing slashes of the site are dropped."""
    return F.concat(F.lit(site.rstrip("/") + EDITOR_PATH), doc_type, F.lit("/"), doc_id)


def is_draft(status: Column) -> Column:
    """P10."""
    return ~status.isin(*PUBLIC_STATUSES)


def link(status: Column, url: Column, editor_url: Column) -> Column:
    """The public address where there is one, else the editor."""
    return F.when(status.isin(*PUBLIC_STATUSES), F.coalesce(url, editor_url)).otherwise(editor_url)


def markdown_link(title: Column, target: Column) -> Column:
    """Brackets in the title are escaped."""
    escaped = F.replace(F.replace(title, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    return F.concat(F.lit("["), escaped, F.lit("]("), target, F.lit(")"))


def display_date(published_at: Column, updated_at: Column) -> Column:
    """P11."""
    return F.substring(F.coalesce(published_at, updated_at), 1, 10)


def tags_to_csv(tags: Column) -> Column:
    """P12, writing."""
    return F.array_join(tags, ",")


def csv_to_tags(csv: Column) -> Column:
    """P12, reading: the empty text is no tag, not one empty tag."""
    return F.when(csv == "", F.array().cast("array<string>")).otherwise(F.split(csv, ","))


def excerpt(plaintext: Column) -> Column:
    """The snippet of a hit found without any text clause."""
    return F.substring(plaintext, 1, EXCERPT_CHARS)


def document_links(docs: DataFrame) -> DataFrame:
    """P8-P11 as extra columns."""
    target = link(F.col("status"), F.col("url"), F.col("editor_url"))
    return docs.withColumns(
        {
            "link": target,
            "markdown": markdown_link(F.col("title"), target),
            "is_draft": is_draft(F.col("status")),
            "display_date": display_date(F.col("published_at"), F.col("updated_at")),
        }
    )
