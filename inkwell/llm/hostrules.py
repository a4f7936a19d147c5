"""Quality rules on the level of hosts: shrunk failure rates decide over whole hosts, base rules over documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import on_workers, settle, table
from inkwell.llm.textscan import IS_FIRST, Texts, blocks, class_of

#: Fixed values of the contract: characters that count as symbols, and words in a window.
SYMBOLS = class_of(b"#*$%&|<>")
WINDOW = 5
#: A host goes if the shrunk rate of documents that fail one of the rules is above this.
HOST_LIMIT = 0.5
#: Bounds of the share of variance that lies between hosts.
LEAST_SPREAD, MOST_SPREAD = 1e-6, 1 - 1e-6

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def rules() -> dict[str, Column]:
    """Rules on a document's counts, true where it fails. A text without words only fails the first."""
    n = F.col("n_words")
    return {
        "few_words": n < 10,
        "repeats": F.col("n_repeat_words") * 100 > n * 20,
        "symbols": F.col("n_symbols") * 10 > n,
        "lines": F.col("n_dup_lines") * 10 > F.col("n_lines") * 3,
        "word_length": (F.col("word_chars") < n * 3) | (F.col("word_chars") > n * 10),
    }


#: Those that decide over a document by itself.
BASE = ("few_words", "repeats")


def document_facts(docs: DataFrame, host: Column | None = None) -> DataFrame:
    """`(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines)` of every row.

    Words are runs without ASCII white space. Null texts have no words. One pass over the texts, no shuffle.
    """

    def batches(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(given):
            texts = Texts(batch["text"])
            n_lines, n_dups = texts.lines()
            counts = [
                texts.n_words(), texts.count(texts.solid & IS_FIRST[texts.data]), texts.count(SYMBOLS[texts.data]),
                n_dups, texts.repeated_words(WINDOW), n_lines,
            ]
            columns = [batch["doc_id"], batch["host"], *(pa.array(c, pa.int64()) for c in counts)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "host", *COUNTS])

    named = F.col("source") if host is None else host
    rows = docs.select(F.col("doc_id").cast("long"), named.cast("string").alias("host"), F.col("text").cast("string"))
    return on_workers(rows, batches, f"doc_id long, host string, {', '.join(f'{c} long' for c in COUNTS)}")


def host_rates(facts: DataFrame) -> DataFrame:
    """`(host, n_docs, <rule>)` with the shrunk failure rate of every rule; rows without a host are left out.

    The prior of a rule is a beta distribution fitted by moments over all hosts: its mean is the common rate, its
    weight follows from how much more the hosts differ than chance lets them. Documents are counted in their
    partitions before the shuffle, so a host may hold any share of the rows; the driver gets one row of sums.
    """
    fails = {name: F.count_if(rule).alias(name) for name, rule in rules().items()}
    hosts = settle(facts.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n_docs"), *fails.values()), "hosts")
    sums = hosts.agg(
        F.count("*").alias("hosts"), F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_docs").cast("double")).alias("squares"),
        *(F.sum(name).alias(name) for name in fails),
        *(F.sum(F.col(name) * F.col(name) / F.col("n_docs")).alias(f"{name}_squares") for name in fails),
    ).first()
    if not sums["hosts"]:
        return hosts

    def shrunk(name: str) -> Column:
        mean, spread = sums[name] / sums["docs"], 0.0
        freedom = sums["docs"] - sums["squares"] / sums["docs"] - (sums["hosts"] - 1)
        if 0 < mean < 1 and freedom > 0:
            between = (sums[f"{name}_squares"] - mean * mean * sums["docs"]) / (mean * (1 - mean))
            spread = (between - (sums["hosts"] - 1)) / freedom
        weight = 1 / min(max(spread, LEAST_SPREAD), MOST_SPREAD) - 1
        return ((F.col(name) + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))).alias(name)

    return hosts.select("host", "n_docs", *map(shrunk, fails))


def quality_rules(docs: DataFrame, host: Column | None = None, limit: float = HOST_LIMIT) -> DataFrame:
    """`(doc_id, host, <counts>, base_failed, host_failed, kept)` of every row of `docs`.

    A document fails by the base rules (under 10 words, or over a fifth of the words in repeated windows) or with its
    host, if the shrunk rate of any rule there is above `limit`. The host is `source` unless a column is given; rows
    without one are decided by the base rules alone. Rows are independent but for their host's rates, so ties and
    repeated rows need no order and null ids stay; other columns are ignored; no rows give no rows.
    """
    facts = settle(document_facts(docs, host), "facts")
    rates = host_rates(facts)
    bad = rates.where(F.greatest(*(F.col(name) for name in rules())) > limit).select("host", F.lit(True).alias("host_failed"))
    base = F.greatest(*(rules()[name] for name in BASE))
    # Written, so that its size is known and a host with many documents can be split in the join.
    judged = facts.join(settle(bad, "failed-hosts"), "host", "left")
    return judged.select(
        "doc_id", "host", *COUNTS, base.alias("base_failed"), F.coalesce("host_failed", F.lit(False)).alias("host_failed")
    ).withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP13_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), windows AS (
    SELECT r, i, list_slice(words, i, i + 4) AS w FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM texts)
), again AS (
    SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1
), covered AS (
    SELECT r, count(DISTINCT i + k) AS n FROM again, range(0, 5) AS t(k) GROUP BY r
), lines AS (
    SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), line_counts AS (
    SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dups FROM lines GROUP BY r
), facts AS (
    SELECT doc_id, source AS host, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           coalesce(n_dups, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
    FROM texts LEFT JOIN line_counts USING (r) LEFT JOIN covered c USING (r)
), failing AS (
    SELECT *, n_words < 10 AS f1, 100 * n_repeat_words > 20 * n_words AS f2, 10 * n_symbols > n_words AS f3,
           10 * n_dup_lines > 3 * n_lines AS f4, word_chars < 3 * n_words OR word_chars > 10 * n_words AS f5
    FROM facts
), hosts AS (
    SELECT host, rule, count(*) AS n, count(*) FILTER (failed) AS f
    FROM (SELECT host, unnest([1, 2, 3, 4, 5]) AS rule, unnest([f1, f2, f3, f4, f5]) AS failed FROM failing WHERE host IS NOT NULL)
    GROUP BY host, rule
), sums AS (
    SELECT rule, count(*) AS h, sum(n) AS docs, sum(n * n) AS squares, sum(f) / sum(n) AS mean, sum(f * f / n) AS fsquares
    FROM hosts GROUP BY rule
), priors AS (
    SELECT rule, mean, 1 / least(greatest(CASE WHEN mean > 0 AND mean < 1 AND docs - squares / docs - (h - 1) > 0
        THEN ((fsquares - mean * mean * docs) / (mean * (1 - mean)) - (h - 1)) / (docs - squares / docs - (h - 1))
        ELSE 0 END, 1e-6), 1 - 1e-6) - 1 AS weight
    FROM sums
), bad AS (
    SELECT DISTINCT host FROM hosts JOIN priors USING (rule) WHERE (f + mean * weight) / (n + weight) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
       NOT (f1 OR f2) AND (host IS NULL OR host NOT IN (SELECT host FROM bad)) AS kept
FROM failing
"""
