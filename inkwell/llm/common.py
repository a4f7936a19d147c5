"""What the operators share: reading tables, written intermediate tables, folds and Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import _ship, on_workers, settle  # noqa: F401  the operators take them from here

#: ASCII white space, as byte strings split it and as the contracts name it.
WHITE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers_pandas(df: DataFrame, batches, schema) -> DataFrame:
    """`mapInPandas` with this package on the workers' path."""
    _ship(df.sparkSession)
    return df.mapInPandas(batches, schema)


_held: dict = {}


def held(key, make):
    """What `make` gives, kept by this worker until another operator keeps something under another key.

    Workers serve one stage after another, so what an earlier one kept must not stay beside that of the next.
    """
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Nothing is kept any more; for stages that keep nothing themselves."""
    if _held:
        _held.clear()
        pa.default_memory_pool().release_unused()


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo; a missing id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, so that what is made of one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts_of(column: pa.Array) -> Iterator[str]:
    """The texts of an Arrow column one by one; null counts as empty."""
    for value in column:
        yield value.as_py() or ""


def ragged(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list row per array."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


#: Bytes of labelled texts that a model is fitted on, at most.
FIT_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int, size: int = FIT_BYTES) -> list[tuple[str, int]]:
    """Whole texts and labels of at most `rows` documents and `size` bytes outside the held-out fold, drawn by a hash of the id.

    The labels are cut to `rows` ids before they meet the documents; an id that repeats counts once. In the order of the
    hash, a text that doesn't fit into the bytes that are left is passed over.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold(modulus) != held))
        .groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # At most `rows` ids are broadcast.
    met = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    met = settle(met, "labelled")
    sizes = met.select(F.xxhash64("doc_id").alias("place"), "doc_id", F.octet_length("text").alias("size")).collect()
    fitting = []
    for r in sorted(sizes):
        if r.size <= size:
            size -= r.size
            fitting.append((r.doc_id,))
    if len(fitting) < len(sizes):
        met = met.join(F.broadcast(met.sparkSession.createDataFrame(fitting, "doc_id long")), "doc_id")
    return [(r.text, r.label) for r in sorted(met.collect(), key=lambda r: r.doc_id)]


def scored(docs: DataFrame, score, modulus: int, held: int, threshold: float) -> DataFrame:
    """`(doc_id, held_out, score, predicted)` of every row; `score` maps an Arrow batch of texts to numbers."""

    def batches(given):
        for batch in slices(given):
            found = pa.array(score(texts_of(batch["text"])), pa.float64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], found], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = on_workers(rows, batches, "doc_id long, score double")
    return rows.select(
        "doc_id", (fold(modulus) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def kept_by_text(docs: DataFrame, decide) -> DataFrame:
    """Rows of `docs`, all columns, whose text `decide` (Arrow texts to booleans) keeps; one pass, no shuffle."""

    def batches(given):
        for batch in slices(given):
            yield batch.filter(pa.array(decide(texts_of(batch["text"])), pa.bool_()))

    return on_workers(docs, batches, docs.schema)
