"""The stored index: built once from documents, opened by searches.

Layout, chosen so that a search reads a small part of a large archive:

* `postings`   partitioned by a hash bucket of the term, sorted by term inside
* `vocab`      partitioned by a hash bucket of the stem
* `documents`  partitioned by a hash bucket of the id, with the token count of each document
* `corpus`     one row: document count, tokens, mean length, number of buckets

Rows are sorted inside a bucket and pages hold few of them, so that the page index of a file, its zone map by term or
id, lets a scan with given values skip nearly all of the bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.fields import DOCUMENT_COLUMNS
from inkwell.operators.indexing import (
    POSTING_COLUMNS,
    bucket_of,
    build_postings,
    build_vocab,
    corpus_stats,
    token_count,
    with_stem_counts,
)
from inkwell.operators.matching import cut_rows
from inkwell.session import settle
from inkwell.sources.archive import DOCUMENT_SCHEMA

# Rows of a page, the least that a scan can skip.
PAGE_ROWS = 2000
STORED_COLUMNS = (*DOCUMENT_COLUMNS, "n_tokens", "id_bucket")


@dataclass(frozen=True)
class ArchiveIndex:
    documents: DataFrame
    postings: DataFrame
    vocab: DataFrame
    n_docs: int
    all_tokens: int
    buckets: int

    @property
    def avg_len(self) -> float:
        # Without documents nothing is scored.
        return self.all_tokens / self.n_docs if self.n_docs else 1.0


def _write_bucketed(df: DataFrame, path: str, bucket: str, sort: list[str]) -> None:
    """One folder per bucket. Every partition writes a sorted file of its own into each bucket that it has rows of."""
    (
        df.sortWithinPartitions(bucket, *sort)
        .write.partitionBy(bucket)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .parquet(path)
    )


def _write_documents(placed: DataFrame, path: str) -> None:
    """Ranges of (bucket, id): an id is in one file, and the work is spread over as many tasks as the session shuffles
    to, whatever the number of buckets and of source files is. Tokens are counted after the shuffle."""
    ranged = placed.select(*DOCUMENT_COLUMNS, "id_bucket").repartitionByRange("id_bucket", "id")
    counted = ranged.withColumn("n_tokens", token_count()).select(*STORED_COLUMNS)
    _write_bucketed(counted, f"{path}/documents", "id_bucket", ["id"])


def _stored_form(docs: DataFrame, buckets: int) -> DataFrame:
    return docs.select(
        *DOCUMENT_COLUMNS,
        token_count().alias("n_tokens"),
        bucket_of(F.col("id"), buckets).alias("id_bucket"),
    )


def _read(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One part of a stored index. The schemas are fixed: without documents or tokens there is no
    file to tell them."""
    documents = _stored_form(spark.createDataFrame([], DOCUMENT_SCHEMA), 1)
    if part == "documents":
        return spark.read.schema(documents.schema).parquet(f"{path}/{part}")
    postings = build_postings(documents).withColumn("term_bucket", bucket_of(F.col("term"), 1))
    if part == "postings":
        return spark.read.schema(postings.schema).parquet(f"{path}/{part}")
    vocab = with_stem_counts(build_vocab(postings)).withColumn("stem_bucket", bucket_of(F.col("stem"), 1))
    return spark.read.schema(vocab.schema).parquet(f"{path}/{part}")


def _finish(spark: SparkSession, postings: DataFrame, path: str, buckets: int) -> ArchiveIndex:
    """Write what follows from the stored documents and the postings. `corpus` comes last: a
    folder without it is no index."""
    # Not shuffled: postings take several times the room of the texts, and a scan finds a term in each file by the page
    # index. So a term that fills a third of the index is spread over tasks as the documents are.
    placed = postings.withColumn("term_bucket", bucket_of(F.col("term"), buckets))
    _write_bucketed(placed, f"{path}/postings", "term_bucket", ["term", "id"])
    stored = _read(spark, path, "postings")
    counted = with_stem_counts(build_vocab(stored)).withColumn("stem_bucket", bucket_of(F.col("stem"), buckets))
    _write_bucketed(counted.hint("rebalance", "stem_bucket"), f"{path}/vocab", "stem_bucket", ["stem", "term"])
    stats = corpus_stats(_read(spark, path, "documents"))
    stats.withColumn("buckets", F.lit(buckets)).coalesce(1).write.parquet(f"{path}/corpus")
    return open_index(spark, path)


def build_index(spark: SparkSession, docs: DataFrame, path: str, buckets: int = 64) -> ArchiveIndex:
    """Write the index of `docs` below `path` and open it."""
    _write_documents(docs.withColumn("id_bucket", bucket_of(F.col("id"), buckets)), path)
    return _finish(spark, build_postings(_read(spark, path, "documents"), buckets), path, buckets)


def open_index(spark: SparkSession, path: str) -> ArchiveIndex:
    corpus = spark.read.parquet(f"{path}/corpus").first()
    return ArchiveIndex(
        documents=_read(spark, path, "documents"),
        postings=_read(spark, path, "postings"),
        vocab=_read(spark, path, "vocab"),
        n_docs=corpus["n_docs"],
        all_tokens=corpus["all_tokens"],
        buckets=corpus["buckets"],
    )


def update_index(
    spark: SparkSession, index: ArchiveIndex, changed: DataFrame, path: str, deleted: DataFrame | None = None
) -> ArchiveIndex:
    """X5 for the whole index: write the next one below `path`.

    Only changed documents are tokenized; the rest is copied with its positions.
    """
    outdated = changed.select("id")
    if deleted is not None:
        outdated = outdated.unionByName(deleted.select("id"))
    outdated = settle(outdated.distinct(), "outdated")
    kept_ids = settle(index.documents.select("id").join(outdated, "id", "left_anti"), "kept-ids")
    kept = index.documents.join(outdated, "id", "left_anti").select(*DOCUMENT_COLUMNS)
    _write_documents(kept.unionByName(changed.select(*DOCUMENT_COLUMNS)).withColumn("id_bucket", bucket_of(F.col("id"), index.buckets)), path)
    held = cut_rows(index.postings, ["id"], kept_ids, outdated).select(*POSTING_COLUMNS)
    return _finish(spark, held.unionByName(build_postings(changed, index.buckets)), path, index.buckets)
