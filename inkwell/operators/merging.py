"""Upsert by id, its counts, and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.fields import DOCUMENT_COLUMNS
from inkwell.operators.matching import is_few
from inkwell.session import settle


def last_records(batch: DataFrame, order: list[str]) -> DataFrame:
    """The last record of every id in arrival order.

    Spark limits each group before the shuffle as well, so an id with very many copies reaches
    its task as one row per input partition.
    """
    newest = Window.partitionBy("id").orderBy(*(F.col(c).desc() for c in order))
    return batch.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def last_of_written(batch: DataFrame, order: list[str]) -> DataFrame:
    """`last_records` of a batch that is written: bodies are shuffled only of ids that occur more than once, where these are few."""
    again = settle(batch.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated-ids")
    if not is_few(again):
        return last_records(batch, order)
    several = last_records(batch.join(F.broadcast(again), "id", "left_semi"), order)
    return batch.join(F.broadcast(again), "id", "left_anti").unionByName(several)


def merge_documents(current: DataFrame, batch: DataFrame, order: list[str], last: DataFrame | None = None) -> DataFrame:
    """M1: every column of a known id is replaced, unknown ids are added. `last` are the last records, if they are known.

    Only the ids of the batch take part in the anti join; a small batch is broadcast by its
    size and the archive is then not shuffled at all.
    """
    kept = current.join(batch.select("id"), "id", "left_anti").select(*DOCUMENT_COLUMNS)
    last = last_records(batch, order) if last is None else last
    return kept.unionByName(last.select(*DOCUMENT_COLUMNS))


def split_batch(current: DataFrame, batch: DataFrame) -> DataFrame:
    """The distinct ids of the batch, with whether they are known already."""
    ids = batch.groupBy("id").agg(F.count("*").alias("n_records"))
    known = current.select("id", F.lit(True).alias("known"))
    return ids.join(known, "id", "left").select("id", "n_records", F.coalesce("known", F.lit(False)).alias("known"))


def merge_counts(current: DataFrame, batch: DataFrame) -> DataFrame:
    """M2: a second copy of a new id in one batch counts as an update."""
    return split_batch(current, batch).agg(
        F.count_if(~F.col("known")).alias("added"),
        F.coalesce(F.sum("n_records") - F.count_if(~F.col("known")), F.lit(0)).cast("long").alias("updated"),
    )


def live_ids(*collections: DataFrame) -> DataFrame:
    """The ids the site still returns."""
    first, *rest = (c.select("id") for c in collections)
    for ids in rest:
        first = first.unionByName(ids)
    return first.distinct()


def prune(current: DataFrame, live: DataFrame) -> DataFrame:
    """Drop what the site no longer returns."""
    return current.join(live.select("id"), "id", "left_semi")


def stale_ids(current: DataFrame, live: DataFrame) -> DataFrame:
    """Ids held but no longer live."""
    return current.select("id").join(live.select("id"), "id", "left_anti")


def removed_count(current: DataFrame, live: DataFrame) -> DataFrame:
    """How many documents a prune drops."""
    return stale_ids(current, live).agg(F.count("*").alias("removed"))
