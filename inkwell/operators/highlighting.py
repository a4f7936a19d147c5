"""Mark the words of a search string in body texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import JS_SPACE


def highlight_words(raw: Column) -> Column:
    """The bare words of a search string: no filters, no leading dash or quotes, two signs or
    more. Unlike matching, this keeps excluded words and the words of phrases."""
    tokens = F.filter(
        F.split(raw, f"[{JS_SPACE}]+", -1),
        lambda t: (t != "") & ~t.rlike(r"(?i)\A(tag|before|after|status|type|title):"),
    )
    bare = F.transform(tokens, lambda t: F.regexp_replace(t, r'\A[-"]+|"+\z', ""))
    return F.filter(bare, lambda t: F.octet_length(F.encode(t, "UTF-16BE")) >= 4)


def highlight_pattern(raw: Column) -> Column:
    """One alternation of the escaped words, or null without words."""
    escaped = F.transform(
        highlight_words(raw), lambda t: F.regexp_replace(t, r"[.*+?^${}()|\[\]\\]", r"\\$0")
    )
    return F.when(F.size(escaped) > 0, F.concat(F.lit("(?iu)("), F.array_join(escaped, "|"), F.lit(")")))


def highlight(hits: DataFrame, log: DataFrame, opening: str, closing: str) -> DataFrame:
    """Add `highlighted`: the body of every hit with the words of its search string marked."""
    sign = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    patterns = log.select("query_id", highlight_pattern(F.col("raw")).alias("_pattern"))
    marked = F.regexp_replace("plaintext", F.col("_pattern"), F.lit(f"{sign(opening)}$1{sign(closing)}"))
    return (
        hits.join(patterns, "query_id")
        .withColumn("highlighted", F.when(F.col("_pattern").isNull(), F.col("plaintext")).otherwise(marked))
        .drop("_pattern")
    )
