"""The corpus pipeline: from documents to token ids, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe, decontamination, exactdedup, quality, simhash
from inkwell.llm.common import kept_by_text, release, settle, table


def _one_of_each(docs: DataFrame, decide) -> DataFrame:
    """The rows that `decide`, given documents and the name of a row key, marks as kept.

    The key is written with the documents, so that it is the same at each reading; ids may repeat or be null.
    """
    row = "row_key"
    while row in map(str.lower, docs.columns):
        row += "_"
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    lost = settle(decide(numbered, row).where(~F.col("kept")).select(F.col("row").alias(row)), "lost")
    return numbered.join(lost, row, "left_anti").select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))

    def good(texts):
        release()
        return [s >= quality.THRESHOLD for s in model.scores(texts)]

    return kept_by_text(docs, good)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return _one_of_each(docs, lambda rows, key: exactdedup.exact_duplicates(rows, row=key))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, the one with the smallest doc_id."""
    return _one_of_each(docs, lambda rows, key: simhash.near_duplicates(rows, row=key))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold an item of the benchmark."""
    for number, block in enumerate(decontamination.item_passes(table(spark, sf_dir, "benchmark"))):
        # Written between passes, so that a plan holds one block.
        docs = settle(docs, "clean") if number else docs

        def clean(texts, block=block):
            index = decontamination.index_of(block)
            return [not index.search(t) for t in texts]

        docs = kept_by_text(docs, clean)
    return docs


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`(doc_id, ids, n_tokens, ids_sha256, decoded_sha256)` of every document, encoded and decoded again."""
    return bpe.digests(bpe.recode(docs), "ids")


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", tokenize),
]

#: The classifier and the fingerprints are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
