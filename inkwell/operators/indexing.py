"""The positional text index as DataFrames.

Postings keep the terms as written (folded) with their stems: a run of equal stems takes no room in sorted files, and a
search for very many terms, as of short prefixes, finds its postings by stem where they are read. Each different word of a
block is stemmed once, and building postings needs no shuffle: documents are grouped by term where they are read. The
vocabulary has one row per distinct term; a search for few terms widens its stems to terms there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.fields import tags_to_csv
from inkwell.functions.grouping import by_tokens, group_tokens
from inkwell.functions.text import count_terms, terms
from inkwell.session import on_workers

# The indexed columns and their ranking weights.
COLUMN_WEIGHTS = {"title": 10.0, "plaintext": 1.0, "tags": 3.0}
INDEXED = tuple(COLUMN_WEIGHTS)
# What filters and scores read of a document. Postings carry it: a search then needs no join
# with the documents before it has its top hits. A changed document replaces all its postings
# anyway, and as dictionary-coded columns these cost little.
DOC_FACTS = ("n_tokens", "type", "status", "tags_csv", "published_at")
POSTING_SCHEMA = (
    "term string, id string, col string, weight double, lead boolean, n_places int, positions array<int>, "
    "n_tokens long, type string, status string, tags_csv string, published_at string, "
    "stem string, stem_lead boolean, title_lead boolean"
)
POSTING_COLUMNS = (
    "term", "id", "col", "weight", "lead", "n_places", "positions", *DOC_FACTS, "stem", "stem_lead", "title_lead"
)
# Tokens that are grouped at a time, about.
BATCH_TOKENS = 1_000_000


def _indexed_text(name: str) -> Column:
    return tags_to_csv(F.col("tags")) if name == "tags" else F.col(name)


def bucket_of(key: Column, buckets: int) -> Column:
    """Storage bucket of a term or an id."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def tokenize(docs: DataFrame) -> DataFrame:
    """One row per token. The documents are read once for all their columns."""
    columns = F.array(*(F.struct(F.lit(name).alias("col"), terms(_indexed_text(name)).alias("terms")) for name in INDEXED))
    return (
        docs.select("id", F.inline_outer(columns))
        .select("id", "col", F.posexplode_outer("terms").alias("pos", "term"))
        .where(F.col("pos").isNotNull())
    )


def token_count() -> Column:
    total = sum((count_terms(_indexed_text(name)) for name in INDEXED), F.lit(0))
    return total.cast("long")


def doc_lengths(docs: DataFrame) -> DataFrame:
    """Tokens of all three columns together; an empty document has none."""
    return docs.select("id", token_count().alias("n_tokens"))


def build_postings(docs: DataFrame, buckets: int = 1) -> DataFrame:
    """Positions per term, document and column.

    Terms are extracted by Spark; the tokens of many documents are then grouped by array operations, without a
    shuffle. Each group comes in the order of the stored postings, which leaves little to a sort of the whole.
    `lead` marks one posting per term and document, for document counts, `stem_lead` one per stem and document and
    `title_lead` one per stem and title; `n_places` spares searches for single terms the positions, which are the bulk of
    the index.
    """
    facts = ("type", "status", tags_to_csv(F.col("tags")).alias("tags_csv"), "published_at")
    listed = docs.select("id", *facts, *(terms(_indexed_text(name)).alias(f"{name}_terms") for name in INDEXED))
    placed = lambda name: F.transform(f"{name}_terms", lambda term: bucket_of(term, buckets)).alias(f"{name}_buckets")
    listed = listed.select("*", *map(placed, INDEXED))

    def batches(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for some in by_tokens(batch, list(INDEXED), BATCH_TOKENS):
                yield group_tokens(some, COLUMN_WEIGHTS, POSTING_COLUMNS)

    return on_workers(listed, batches, POSTING_SCHEMA)


def build_vocab(postings: DataFrame) -> DataFrame:
    """Distinct terms with stem and the documents that hold them, anywhere and in the title.

    `stem_leads` and `title_leads` count the documents of the stem that are marked at this term.
    """
    return postings.groupBy("term", "stem").agg(
        F.count_if("lead").alias("n_docs"), F.count_if(F.col("col") == "title").alias("n_title"),
        F.count_if("stem_lead").alias("stem_leads"), F.count_if("title_lead").alias("title_leads"),
    )


def with_stem_counts(vocab: DataFrame) -> DataFrame:
    """A8 in advance: `stem_docs` and `stem_title_docs`, the documents that hold a term of the stem.

    A search then knows the frequency of a plain word, and which of its words is the rarest, before it reads a posting.
    Every document is marked at one term of a stem that it holds, so the marks of its terms add up and no posting is
    read again.
    """
    of_stem = Window.partitionBy("stem")
    return vocab.select(
        "term", "stem", "n_docs", "n_title",
        F.sum("stem_leads").over(of_stem).alias("stem_docs"), F.sum("title_leads").over(of_stem).alias("stem_title_docs"),
    )


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row; size, tokens and mean length of the whole archive."""
    return lengths.agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens"),
        F.coalesce(F.avg("n_tokens"), F.lit(0.0)).alias("avg_len"),
    )


def update_postings(postings: DataFrame, changed: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Take out the postings of changed and deleted documents, put in those of the changed.

    `postings` are the stored ones; only the changed documents are tokenized. The outdated ids
    are a narrow frame, broadcast where its size allows.
    """
    outdated = changed.select("id")
    if deleted is not None:
        outdated = outdated.unionByName(deleted.select("id"))
    kept = postings.join(outdated, "id", "left_anti")
    return kept.select(*POSTING_COLUMNS).unionByName(build_postings(changed))
