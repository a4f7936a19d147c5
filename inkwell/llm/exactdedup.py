"""Exact deduplication with an extendible-hash index of the texts on shared files, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import WHITE, settle, table

#: Keys that a bucket holds before it is split.
CAPACITY = 4096
#: Buckets that one owner task takes, about.
BUCKETS_PER_OWNER = 32


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE + "+", "")


def key_rows(docs: DataFrame, row: str | None = None) -> DataFrame:
    """`(doc_id, hash, text_sha256)` of every row, and `row` if a row key is named."""
    own = [F.col(row).alias("row")] if row else []
    rows = docs.select(F.col("doc_id").cast("long"), normalised(F.col("text")).alias("norm"), *own)
    key = [F.xxhash64("norm").alias("hash"), F.sha2("norm", 256).alias("text_sha256")]
    return rows.select("doc_id", *key, *(["row"] if row else []))


def _slot(depth: int) -> Column:
    """The leading bits of the hash: its place in a directory of that depth."""
    return F.shiftrightunsigned("hash", 64 - depth) if depth else F.lit(0).cast("long")


def directory(hashes: DataFrame, capacity: int = CAPACITY) -> tuple[int, DataFrame]:
    """Global depth and `(slot, depth, bucket)` for the distinct `hash` rows.

    The directory doubles until no slot is overfull. Slots that share a shallower bucket point to it: a bucket's own
    depth is the least at which its keys fit. The first depth is the least that can hold all keys.
    """
    n = hashes.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / capacity)))
    while True:
        slots = settle(hashes.groupBy(_slot(depth).alias("slot")).agg(F.count("*").alias("n")), "directory")
        if depth >= 62 or (slots.agg(F.max("n")).first()[0] or 0) <= capacity:
            break
        depth += 1
    up = lambda d: F.expr(f"shiftrightunsigned(slot, {depth} - {d})")
    levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    sums = levels.groupBy("depth", up("depth").alias("bucket")).agg(F.sum("n").alias("n"))
    fit = levels.drop("n").withColumn("bucket", up("depth")).join(sums, ["depth", "bucket"])
    own = fit.where((F.col("n") <= capacity) | (F.col("depth") == depth)).groupBy("slot").agg(F.min("depth").alias("depth"))
    # A bucket is named by its first slot, so that owners take neighbouring buckets.
    return depth, own.select("slot", "depth", F.expr(f"shiftleft(shiftrightunsigned(slot, {depth} - depth), {depth} - depth)").alias("bucket"))


def build_index(docs: DataFrame, keys: DataFrame, capacity: int = CAPACITY, row: str | None = None) -> DataFrame:
    """Index files `(bucket, hash, text_sha256, copies, keep_id)`, one entry per distinct text, written by key range;
    with `row` also `keep_row`.

    Equal texts meet by hash and byte comparison of the whole normalised text, pre-aggregated before the shuffle, so
    a text with any number of copies is one entry; the entry names the row that stays. Owners of key ranges write their
    buckets in hash order.
    """
    depth, slots = directory(keys.select("hash").distinct(), capacity)
    slots = settle(slots, "directory")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The bitwise complement turns the order of the ids round without overflow; nulls come last.
    rank = [F.char_length(text).alias("n_chars"), F.bitwise_not(F.col("doc_id").cast("long")).alias("turned")]
    rank += [F.bitwise_not(F.col(row)).alias("turned_row")] if row else []
    texts = docs.select(normalised(F.col("text")).alias("norm"), F.struct(*rank).alias("rank")).select(F.xxhash64("norm").alias("hash"), "norm", "rank")
    entries = texts.groupBy("hash", "norm").agg(F.count("*").alias("copies"), F.max("rank").alias("best"))
    kept = [F.bitwise_not("best.turned").alias("keep_id")] + ([F.bitwise_not("best.turned_row").alias("keep_row")] if row else [])
    entries = entries.select("hash", F.sha2("norm", 256).alias("text_sha256"), "copies", *kept, _slot(depth).alias("slot"))
    owners = max(1, math.ceil(slots.select("bucket").distinct().count() / BUCKETS_PER_OWNER))
    placed = entries.join(slots, "slot").drop("slot", "depth")
    return settle(placed.repartitionByRange(owners, "bucket", "hash").sortWithinPartitions("bucket", "hash"), "hash-index")


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, row: str | None = None) -> DataFrame:
    """`(doc_id, keep_id, group_size, kept, text_sha256, bucket, chain)` of every row of `docs`.

    Texts are equal when identical without ASCII white space; null, empty and blank texts form one group. Of a group
    the row with the most characters, then the smallest doc_id stays. Different texts with one hash are chained: each
    has its own `chain` number in the bucket. Every row takes its answer from its entry in the index. Rows that repeat
    a doc_id with the same text share one decision. A null doc_id loses against any other; in a group of such rows
    only, keep_id is null and all stay. Other columns are ignored; no rows give no rows.

    With `row`, a column of unique whole numbers, `row` is returned too and exactly one row of each group is kept: of
    rows alike in characters and doc_id, null included, the one with the least number.
    """
    keys = settle(key_rows(docs, row), "keys")
    index = build_index(docs, keys, capacity, row)
    order = Window.partitionBy("bucket", "hash").orderBy("text_sha256")
    # Rows find their entry by hash and digest; entries of different bytes must not share both.
    differs = F.coalesce(F.lag("text_sha256").over(order) != F.col("text_sha256"), F.lit(True))
    chained = index.withColumns({"chain": F.row_number().over(order) - 1, "differs": differs})
    sound = F.assert_true(F.col("differs"), F.lit("different texts have equal SHA-256 digests"))
    entries = chained.select(
        "hash", "text_sha256", "bucket", "chain", "keep_id", F.when(sound.isNull(), F.col("copies")).alias("group_size"),
        *(["keep_row"] if row else []),
    )
    # Written first, so that both sides of the join are dealt out by it and a hot group can be split.
    entries = settle(entries, "entries")
    kept = F.col("row") == F.col("keep_row") if row else F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return keys.join(entries, ["hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "bucket", "chain", *(["row"] if row else []),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


OP6_SQL = r"""
WITH keyed AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_chars,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
    FROM documents
), ranked AS (
    SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id
    FROM keyed
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""
