"""Counts, health and output forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fields
from inkwell.functions.fields import DOC_TYPES
from inkwell.functions.text import collapse_space, strip_space

# Fixed values of the output texts.
NO_MATCHES = "No matches. Try fewer words, or drop any tag: and date filters."
NO_BODY = "This post has no body text."
EMPTY_SHARE_ALARM = 0.9


def document_count(docs: DataFrame) -> DataFrame:
    """A1."""
    return docs.agg(F.count("*").alias("n_docs"))


def document_ids(docs: DataFrame) -> DataFrame:
    """A2."""
    return docs.select("id").distinct()


def archive_health(docs: DataFrame) -> DataFrame:
    """A1, A3, A4: size, empty bodies, and whether nearly all bodies are empty."""
    counts = docs.agg(F.count("*").alias("n_docs"), F.count_if(F.col("plaintext") == "").alias("n_empty"))
    alarm = (F.col("n_docs") > 0) & (F.col("n_empty") >= F.lit(EMPTY_SHARE_ALARM) * F.col("n_docs"))
    return counts.withColumn("alarm", alarm)


def type_counts(docs: DataFrame) -> DataFrame:
    """Documents per type; a type without any counts zero."""
    per_type = docs.agg(*(F.count_if(F.col("type") == t).alias(t) for t in DOC_TYPES))
    rows = F.array(*(F.struct(F.lit(t).alias("type"), F.col(t).alias("n_docs")) for t in DOC_TYPES))
    return per_type.select(F.inline(rows))


def age_text(then: Column, now: Column) -> Column:
    """How long ago, in the largest whole unit below."""
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    minutes = F.floor(seconds / 60_000_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)

    def ago(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago"))

    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, ago(minutes, "minute"))
        .when(hours < 24, ago(hours, "hour"))
        .otherwise(ago(days, "day"))
    )


def size_text(n_bytes: Column) -> Column:
    """Bytes for people."""
    b = n_bytes.cast("double")
    return (
        F.when(b < 1024, F.concat(n_bytes.cast("string"), F.lit(" B")))
        .when(b < 1024 * 1024, F.concat(F.round(b / 1024).cast("long").cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", b / (1024 * 1024)), F.lit(" MB")))
    )


def status_report(docs: DataFrame, state: DataFrame, now: str) -> DataFrame:
    """Document count, last sync and its age. `now` is an ISO time."""
    last = state.where(F.col("key") == "last_sync_at").agg(F.max("value").alias("last_sync")).scalar()
    report = docs.agg(F.count("*").alias("n_docs")).withColumn("last_sync_at", last)
    age = F.when(F.col("last_sync_at").isNull(), "never").otherwise(age_text(F.col("last_sync_at"), F.lit(now)))
    return report.withColumn("age", age)


def stored_bytes(stored: DataFrame) -> DataFrame:
    """Size of the files behind a file-based frame."""
    files = stored.select("_metadata.file_path", "_metadata.file_size").distinct()
    total = files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("n_bytes"))
    return total.withColumn("size", size_text(F.col("n_bytes")))


def hit_counts(log: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits per query after the limit; queries without hits count zero."""
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    return log.select("query_id").join(counts, "query_id", "left").select(
        "query_id", F.coalesce("n", F.lit(0)).alias("n_hits")
    )


def _hit_link() -> Column:
    return fields.link(F.col("status"), F.col("url"), F.col("editor_url"))


def _draft_mark() -> Column:
    return F.when(fields.is_draft(F.col("status")), F.concat(F.lit(" ["), "status", F.lit("]"))).otherwise("")


def _hit_date() -> Column:
    return fields.display_date(F.col("published_at"), F.col("updated_at"))


def hits_to_json(hits: DataFrame) -> DataFrame:
    """One JSON object per hit, thirteen fields, nulls kept, no body."""
    shape = F.struct(
        "id", "type", "status", "title", "slug",
        _hit_link().alias("link"),
        "url",
        F.col("editor_url").alias("editorUrl"),
        "tags",
        F.col("published_at").alias("publishedAt"),
        F.col("updated_at").alias("updatedAt"),
        "snippet", "score",
    )
    return hits.select("query_id", "rank", F.to_json(shape, {"ignoreNullFields": "false"}).alias("json"))


def hits_to_json_array(log: DataFrame, hits: DataFrame) -> DataFrame:
    """One JSON array per query, empty without hits. At most `limit` hits make an array."""
    lists = hits_to_json(hits).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "json"))).alias("hits")
    )
    items = F.array_join(F.transform("hits", lambda h: h["json"]), ",")
    return log.select("query_id").join(lists, "query_id", "left").select(
        "query_id", F.concat(F.lit("["), F.coalesce(items, F.lit("")), F.lit("]")).alias("json")
    )


def hits_to_text(hits: DataFrame) -> DataFrame:
    """The lines of one hit: rank, title and date; link; snippet where there is one."""
    snippet = collapse_space(F.col("snippet"))
    head = F.format_string("%2d. %s%s  %s", "rank", "title", _draft_mark(), _hit_date())
    indented = lambda c: F.concat(F.lit("    "), c)
    lines = F.concat_ws("\n", head, indented(_hit_link()), F.when(snippet != "", indented(snippet)))
    return hits.select("query_id", "rank", lines.alias("text"))


def result_lists(log: DataFrame, hits: DataFrame) -> DataFrame:
    """The whole printed list per query, or the fixed sentence where nothing matched."""
    lists = hits_to_text(hits).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("hits")
    )
    text = F.array_join(F.transform("hits", lambda h: h["text"]), "\n\n")
    return log.select("query_id").join(lists, "query_id", "left").select(
        "query_id", F.coalesce(text, F.lit(NO_MATCHES)).alias("text")
    )


def article_cards(hits: DataFrame) -> DataFrame:
    """Title, facts, link, then the body, or the snippet, or the fixed sentence."""
    facts = F.concat_ws(
        "  ·  ",
        _hit_date(),
        F.col("type"),
        F.when(F.size("tags") > 0, F.array_join("tags", ", ")),
        F.when(fields.is_draft(F.col("status")), F.col("status")),
    )
    body = strip_space(F.col("plaintext"))
    passage = collapse_space(F.col("snippet"))
    text = F.when(body != "", body).when(passage != "", passage).otherwise(NO_BODY)
    return hits.select("query_id", "rank", F.concat_ws("\n", "title", facts, _hit_link(), F.lit(""), text).alias("card"))
