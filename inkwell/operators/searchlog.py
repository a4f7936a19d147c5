"""A column of raw search strings to filters and text clauses, without shuffle or UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.fields import DOC_STATUSES, DOC_TYPES
from inkwell.functions.text import JS_SPACE, terms
from inkwell.session import build_once

POSITIVE = ("title", "term")
FILTERS = ("tag", "before", "after", "status", "type")


def split_tokens(raw: Column) -> Column:
    """Quoted runs stay whole and are closed; an unfinished one is a single open token."""
    segments = F.split(raw, '"', -1)
    token = lambda text, is_open: F.struct(text.alias("text"), is_open.alias("open"))
    none = F.array().cast("array<struct<text:string,open:boolean>>")

    def segment_tokens(segment: Column, i: Column) -> Column:
        words = F.filter(F.split(segment, f"[{JS_SPACE}]+", -1), lambda w: w != "")
        outside = F.transform(words, lambda w: token(w, F.lit(True)))
        unfinished = i == F.size(segments) - 1
        return (
            F.when(i % 2 == 0, outside)
            .when(segment == "", none)
            .otherwise(F.array(token(segment, unfinished)))
        )

    return F.flatten(F.transform(segments, segment_tokens))


def _full_date(value: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD as a full date, else null. There is no calendar check."""
    return (
        F.when(value.rlike(r"\A[0-9]{4}\z"), F.concat(value, F.lit("-01-01")))
        .when(value.rlike(r"\A[0-9]{4}-[0-9]{2}\z"), F.concat(value, F.lit("-01")))
        .when(value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), value)
    )


def _classify(token: Column) -> Column:
    """What a token is: a filter with a valid value, a title clause, an exclusion or a term."""
    text = token["text"]
    colon = F.instr(text, ":")
    value = F.substring(text, colon + 1, F.char_length(text))
    key = F.when(
        token["open"] & (colon > 1) & (value != ""), F.lower(F.substring(text, F.lit(1), colon - 1))
    ).otherwise("")
    low, date = F.lower(value), _full_date(value)
    as_struct = lambda kind, content: F.struct(
        (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"),
        content.alias("value"),
        token["open"].alias("open"),
    )
    return (
        F.when(key.isin("title", "tag"), as_struct(key, value))
        .when(key.isin("before", "after") & date.isNotNull(), as_struct(key, date))
        .when((key == "status") & low.isin(*DOC_STATUSES), as_struct(key, low))
        .when((key == "type") & low.isin(*DOC_TYPES), as_struct(key, low))
        .when(
            token["open"] & text.startswith("-") & (F.char_length(text) > 1),
            as_struct("negated", F.substring(text, F.lit(2), F.char_length(text))),
        )
        .otherwise(as_struct("term", text))
    )


@build_once
def classified_tokens(name: str) -> Column:
    return F.transform(split_tokens(F.col(name)), _classify)


def parse_log(log: DataFrame) -> DataFrame:
    """The log with `tokens` (classified, in order), the five filters and `n_positive`."""
    tokens = F.col("tokens")
    last = lambda kind: F.try_element_at(
        F.filter(tokens, lambda t: t["kind"] == kind), F.lit(-1)
    )["value"]
    return (
        log.withColumn("tokens", classified_tokens("raw"))
        .withColumns({name: last(name) for name in FILTERS})
        .withColumn("n_positive", F.size(F.filter(tokens, lambda t: t["kind"].isin(*POSITIVE))))
    )


def queries_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("query_id", "raw", *FILTERS, "n_positive")


def clauses_of(parsed: DataFrame) -> DataFrame:
    """One row per text clause of a parsed log.

    Exclusions without a positive clause vanish. Prefix search is for the last positive clause,
    if it is an open plain term.
    """
    place = F.array_max(
        F.transform(F.col("tokens"), lambda t, i: F.when(t["kind"].isin(*POSITIVE), i))
    )
    rows = (
        parsed.withColumn("last_positive", place)
        .select("query_id", "prefix_last", "n_positive", "last_positive",
                F.posexplode_outer("tokens").alias("clause_no", "token"))
        .where((F.col("n_positive") > 0) & F.col("token.kind").isin(*POSITIVE, "negated"))
    )
    prefix = (
        F.coalesce(F.col("prefix_last"), F.lit(False))
        & (F.col("clause_no") == F.col("last_positive"))
        & (F.col("token.kind") == "term")
        & F.col("token.open")
    )
    return rows.select(
        "query_id",
        "clause_no",
        (F.col("token.kind") == "negated").alias("negated"),
        (F.col("token.kind") == "title").alias("title_only"),
        prefix.alias("prefix"),
        F.col("token.value").alias("text"),
        terms(F.col("token.value")).alias("terms"),
    )


def search_log_clauses(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`queries` (one row per log row) and `clauses` (one row per text clause) of a log with
    `query_id`, `raw`, `prefix_last`."""
    parsed = parse_log(log)
    return queries_of(parsed), clauses_of(parsed)
