"""Shards by proportional stratified interleaving, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import settle, table

SHARDS = 16
SEED = 20240229
#: Rows that are ranked in one task's window, about.
CELL_ROWS = 8192


def _ranked(rows: DataFrame, stratum: list[str], cell: Column, order: list[str]) -> DataFrame:
    """Adds `rank` (from 1) within the stratum and `total`, its rows.

    Cells follow the order and hold about CELL_ROWS rows each, whatever the size of the stratum: rows are ranked
    within their cell, and only the cells' counts are summed up along the stratum.
    """
    rows = rows.withColumn("cell", cell)
    counts = rows.groupBy(*stratum, "cell").agg(F.count("*").alias("n"))
    along = Window.partitionBy(*stratum)
    counts = counts.select(
        *stratum, "cell",
        (F.sum("n").over(along.orderBy("cell")) - F.col("n")).alias("before"),
        F.sum("n").over(along).alias("total"),
    )
    within = rows.withColumn("place", F.row_number().over(Window.partitionBy(*stratum, "cell").orderBy(*order)))
    joined = within.join(counts, [*stratum, "cell"])
    return joined.withColumn("rank", F.col("place") + F.col("before")).drop("cell", "place", "before")


def shards(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """`(doc_id, size, text_crc32, source, shard, slot)` of every row of `docs`.

    Rows are shuffled by a seeded hash within each source and get the fractional rank (rank - 1/2) / rows of the
    source. Sorted by it, every run of rows has the mixture of the whole, and the order is cut into shards whose row
    counts differ by one at most. Equal texts get no special treatment. A null source counts as the empty one, a null
    text as empty with size 1; null doc_ids are shuffled by text. Repeated rows each get a place of their own. Other
    columns are ignored; no rows give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
    )
    drawn = F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text_crc32")))
    rows = settle(rows.withColumn("drawn", drawn), "shard-rows")
    n = rows.count()
    ties = ["drawn", "doc_id", "text_crc32", "size", "source"]
    # Each source has cells of its own number, so that those of a large one are no larger.
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / CELL_ROWS))).cast("int").alias("bits")
    rows = rows.join(settle(rows.groupBy("source").agg(bits), "sources"), "source")
    # The sign bit is turned so that cells follow the signed order of the hash.
    ordered = F.col("drawn").bitwiseXOR(F.lit(-(1 << 63)))
    top = F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", ordered, 64 - F.col("bits")))
    within = _ranked(rows, ["source"], top, ties)
    within = within.withColumn("fraction", (2 * F.col("rank") - 1) / (2 * F.col("total"))).drop("rank", "total")
    cell = F.floor(F.col("fraction") * math.ceil(max(1, n) / CELL_ROWS))
    placed = _ranked(within.withColumn("all", F.lit(0)), ["all"], cell, ["fraction", *ties])
    at = F.col("rank") - 1
    shard = F.expr(f"((rank - 1) * {n_shards}L) div {max(1, n)}L")
    first = F.expr(f"(shard * {max(1, n)}L + {n_shards - 1}L) div {n_shards}L")
    return placed.withColumn("at", at).withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", "source", "shard", (F.col("at") - first).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write the rows of `docs` into one folder per shard, in slot order within a file. Needs unique doc_ids."""
    rows = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
