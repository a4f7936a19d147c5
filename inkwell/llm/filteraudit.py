"""Filter interaction audit: what each filter removes, alone and after the others, in every order of application."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import on_workers, settle, table, texts_of
from inkwell.llm.textscan import IS_FIRST, Texts, blocks, class_of

#: The filters; the bit of a filter in a mask is its place here. E is the one that needs all documents.
FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
#: Fixed values of the contract.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
MARKS, CAPITALS = class_of(b"#$%&*|"), class_of(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")

#: Slots of the sketch per row, and probes per text.
SLOTS_PER_ROW, PROBES = 16, 3
#: Bound of the sketch, 64 MB as bits. With more rows it is denser and clears fewer texts, never wrong ones.
MAX_SLOT_BITS = 29
#: Slots of a part of the sketch that one task merges.
PART_BITS = 22


# --- the sketch ----------------------------------------------------------------------------
def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """PROBES slots for every 64-bit key, one row each: parts of the key and odd multiples of it."""
    keys = keys.view(np.uint64) if keys.dtype == np.int64 else keys.astype(np.uint64)
    odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
    return np.stack([(keys * np.uint64(m)) >> np.uint64(64 - bits) for m in odd[:PROBES]]).astype(np.int64)


def _texts_probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and how often each is hit, up to two; a text that hits a slot more than once counts once there."""
    slots = np.sort(_probes(keys, bits), axis=0)
    once = np.ones(slots.shape, bool)
    once[1:] = slots[1:] != slots[:-1]
    found, n = np.unique(slots[once], return_counts=True)
    return found, np.minimum(n, 2)


def sketch(keys: DataFrame, bits: int) -> DataFrame:
    """`(part, twice)`: the counting Bloom filter of a column `key`, a bit per slot that holds two or more.

    Every partition makes counters of its own, cut at two, and sends on the slots it hits; parts of the sketch are
    merged by adding them up. A partition sends a text with any number of copies once.
    """
    part_bits = min(bits, PART_BITS)
    size = 1 << part_bits

    def count(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.zeros((1 << bits) // 8, np.uint8)
        two = np.zeros((1 << bits) // 8, np.uint8)
        for batch in given:
            slots, n = _texts_probes(batch["key"].to_numpy(zero_copy_only=False), bits)
            byte, bit = slots >> 3, np.uint8(1) << (slots & 7).astype(np.uint8)
            again = (n > 1) | (one[byte] & bit != 0)
            np.bitwise_or.at(two, byte[again], bit[again])
            np.bitwise_or.at(one, byte, bit)
        for start in range(0, len(one), size // 8 or 1):
            a, b = one[start : start + max(1, size // 8)], two[start : start + max(1, size // 8)]
            if a.any():
                row = [pa.array([start * 8 // size]), pa.array([_packed(a)], pa.binary()), pa.array([_packed(b)], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, ["part", "one", "two"])

    def merge(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, one, two = None, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([two.tobytes()], pa.binary())], ["part", "twice"])

        for batch in given:
            for this, a, b in zip(batch["part"].to_pylist(), batch["one"], batch["two"]):
                a, b = _unpacked(a.as_py(), size), _unpacked(b.as_py(), size)
                if this != part:
                    if part is not None:
                        yield row()
                    part, one, two = this, a, b
                else:
                    two |= b | (one & a)
                    one |= a
        if part is not None:
            yield row()

    counted = on_workers(keys.select("key"), count, "part long, one binary, two binary")
    # Sketches of one part follow each other and are added up one by one.
    placed = counted.repartition(1 << (bits - part_bits), "part").sortWithinPartitions("part")
    return on_workers(placed, merge, "part long, twice binary")


def _packed(bits: np.ndarray) -> bytes:
    """The bytes of a part, or only those that are set with their places if that is shorter."""
    at = np.flatnonzero(bits)
    if 5 * len(at) + 1 < len(bits):
        return b"s" + at.astype("<u4").tobytes() + bits[at].tobytes()
    return b"d" + bits.tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    if data[:1] == b"d":
        return np.frombuffer(data[1:], np.uint8).copy()
    n = (len(data) - 1) // 5
    bits = np.zeros(max(1, size // 8), np.uint8)
    bits[np.frombuffer(data, "<u4", n, 1)] = np.frombuffer(data, np.uint8, n, 1 + 4 * n)
    return bits


class Sketch:
    """The merged sketch: a text of which some slot was hit once is unique."""

    def __init__(self, parts: dict[int, bytes], bits: int):
        self.bits, self.part_bits = bits, min(bits, PART_BITS)
        self.parts = parts

    def may_repeat(self, keys: np.ndarray) -> np.ndarray:
        if not hasattr(self, "twice"):
            self.twice = np.zeros((1 << self.bits) // 8, np.uint8)
            for part, data in self.parts.items():
                start = (part << self.part_bits) // 8
                self.twice[start : start + len(data)] = np.frombuffer(data, np.uint8)
        slots = _probes(keys, self.bits)
        return ((self.twice[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).all(0)

    def __getstate__(self):
        return {"parts": self.parts, "bits": self.bits, "part_bits": self.part_bits}


def key_of(digests: list[bytes]) -> np.ndarray:
    """The sketch's key of SHA-256 digests."""
    return np.frombuffer(b"".join(d[:8] for d in digests), "<i8")


# --- flags ---------------------------------------------------------------------------------
def _text_of(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")


def text_flags(docs: DataFrame) -> DataFrame:
    """`(doc_id, part, mask, key, digest)` of every row: which of the filters A to D fail, and the text's SHA-256."""

    def batches(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(given):
            texts = Texts(batch["text"])
            n, code_points = texts.n_words(), texts.count(IS_FIRST[texts.data])
            failed = (
                n < MIN_WORDS, 100 * texts.n_distinct() < DISTINCT_PERCENT * n,
                100 * texts.count(CAPITALS[texts.data]) > CAPITAL_PERCENT * code_points, texts.count(MARKS[texts.data]) > 0,
            )
            mask = sum(f.astype(np.int32) << i for i, f in enumerate(failed))
            digests = [hashlib.sha256(t.encode()).digest() for t in texts_of(batch["text"])]
            columns = [batch["doc_id"], batch["part"], pa.array(mask, pa.int32()), pa.array(key_of(digests)), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "mask", "key", "digest"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), _text_of(docs))
    return on_workers(rows, batches, "doc_id long, part string, mask int, key long, digest binary")


def _marked(rows: DataFrame, seen: Sketch) -> DataFrame:
    """`rows` with `may_repeat`, looked up in the sketch."""

    def batches(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            yield batch.append_column("may_repeat", pa.array(seen.may_repeat(batch["key"].to_numpy(zero_copy_only=False))))

    return on_workers(rows, batches, rows.select("*", F.lit(True).alias("may_repeat")).schema)


def _possible_texts(docs: DataFrame, seen: Sketch) -> DataFrame:
    """`(doc_id, text)` of the rows whose text may occur twice."""

    def batches(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(given):
            keys = key_of([hashlib.sha256(t.encode()).digest() for t in texts_of(batch["text"])])
            yield batch.filter(pa.array(seen.may_repeat(keys)))

    rows = docs.select(F.col("doc_id").cast("long"), _text_of(docs))
    return on_workers(rows, batches, "doc_id long, text string")


def flags(docs: DataFrame) -> DataFrame:
    """`(doc_id, part, mask)` of every row of `docs`: bit i is set if filter i of FILTERS fails.

    E fails if a row with a smaller doc_id has the identical text; a null id is smaller than none and has none
    smaller, and rows that repeat the least id of a text all pass. A merged counting Bloom filter clears the texts that
    are surely unique; only the others are shuffled, as whole texts pre-aggregated to their least id.
    """
    rows = settle(text_flags(docs), "text-flags")
    bits = min(MAX_SLOT_BITS, max(10, math.ceil(math.log2(max(1, rows.count()) * SLOTS_PER_ROW))))
    # At most 2 ** MAX_SLOT_BITS bits in all come to the driver and go back to the workers.
    seen = Sketch({r.part: bytes(r.twice) for r in sketch(rows, bits).collect()}, bits)
    marked = settle(_marked(rows, seen).drop("key"), "marked")
    least = _possible_texts(docs, seen).groupBy("text").agg(F.min("doc_id").alias("doc_id")).where(F.col("doc_id").isNotNull())
    firsts = least.select(F.unhex(F.sha2("text", 256)).alias("digest"), "doc_id", F.lit(True).alias("is_first"))
    # Digest and id together: no key of this join has more rows than repeat one id.
    met = marked.where("may_repeat").join(settle(firsts, "first-ids"), ["digest", "doc_id"], "left")
    repeats = F.col("is_first").isNull() & F.col("doc_id").isNotNull()
    mask = F.when(repeats, F.col("mask").bitwiseOR(F.lit(REPEAT))).otherwise(F.col("mask")).alias("mask")
    return marked.where(~F.col("may_repeat")).select("doc_id", "part", "mask").unionByName(met.select("doc_id", "part", mask))


# --- the audit -----------------------------------------------------------------------------
def mask_counts(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """`(part, mask, n, good, toxic)`: how many documents fail exactly these filters, and how many of them are labelled so.

    A document is good or toxic if any label of its id says so. At most 32 rows a part, counted before the shuffle.
    """
    own = labels.select(F.col("doc_id").cast("long"), "quality", "toxic").where(F.col("doc_id").isNotNull()).groupBy("doc_id")
    known = settle(own.agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic")), "labels")
    return flagged.join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("is_good").alias("good"), F.count_if("is_toxic").alias("toxic")
    )


def _steps() -> Column:
    """All orders of the filters, step by step: the order, the step, the filter's bit and the mask of those before it."""
    rows = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            rows.append(F.struct(F.lit(order).alias("filter_order"), F.lit(step).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")))
            before |= bit
    return F.array(*rows)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, with the document counts of that step.

    `kept`, `removed`, `redundant`, `unique_fails`, `good_lost`, `toxic_lost` and `shapley` all follow from the counts
    of 32 masks a part: what a filter removes over all orders is, for a mask of k failures with it, n * 120 / k. Null
    texts count as empty, a null lang as an empty one; no rows give no rows; other columns are ignored.
    """
    masks = settle(mask_counts(flags(docs), labels), "mask-counts")
    rows = masks.select("part", "mask", "n", "good", "toxic", F.inline(_steps()))
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    here = fails & ~earlier
    of = lambda condition, n="n": F.coalesce(F.sum(F.when(condition, F.col(n))), F.lit(0)).cast("long")
    share = F.when(fails, F.col("n") * (F.lit(math.factorial(len(FILTERS))) / F.bit_count("mask")).cast("long")).otherwise(F.lit(0))
    return rows.groupBy("part", "filter_order", "step").agg(
        of(~fails & ~earlier).alias("kept"), of(here).alias("removed"), of(fails & earlier).alias("redundant"),
        of(F.col("mask") == F.col("bit")).alias("unique_fails"), of(here, "good").alias("good_lost"),
        of(here, "toxic").alias("toxic_lost"), F.sum(share).cast("long").alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), flagged AS (
    SELECT doc_id, part,
           (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
           + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
           + 8 * regexp_matches(text, '[#$%&*|]')::INT
           + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
    FROM texts
), known AS (
    SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), masks AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM flagged LEFT JOIN known USING (doc_id) GROUP BY part, mask
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps AS (
    SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS before
    FROM orders, range(1, 6) AS t(step)
), counted AS (
    SELECT part, filter_order, step, bit,
           coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
           coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
           coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
    FROM masks, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""
