"""SimHash fingerprints and near-duplicate classes by tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import on_workers, settle, slices, table, texts_of
from inkwell.llm.graph import components

SHINGLE = 3
RADIUS = 2
#: Fingerprints in a tile, about; two tiles are compared in one go.
TILE = 512
#: A fingerprint is cut into so many parts, whose population counts place it.
PARTS = 4
WIDTH = 64 // PARTS

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_AT = np.arange(8) * 256


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of `size` words, or of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[i:] for i in range(size))) if len(words) >= size else [words]
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(b" ".join(r), 42) for r in runs), np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes set each of the 64 bits, lowest bit first."""
    where = (hashes.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel()
    return (np.bincount(where, minlength=2048).reshape(8, 256) @ _BITS).ravel()


def fingerprint(words: list[bytes], size: int = SHINGLE, step: int = 1 << 16) -> int:
    """Bits that over half of the shingles set; zero without words. Long texts go through in steps."""
    total, counts = 0, np.zeros(64, np.int64)
    for start in range(0, max(1, len(words) - size + 1), step):
        hashes = shingle_hashes(words[start : start + step + size - 1], size)
        total += len(hashes)
        counts += bit_counts(hashes)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<i8")[0])


def _fingerprint_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [fingerprint(t.encode().lower().split()) for t in texts_of(batch["text"])]
        own = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in own), pa.array(found, pa.int64())], [*own, "fp"])


def fingerprints(docs: DataFrame, row: str | None = None) -> DataFrame:
    """`(doc_id, fp)` of every row, and `row` between if a row key is named.

    Letters A-Z are lowered, words end at ASCII white space; null counts as empty.
    """
    own = [F.col(row).cast("long").alias("row")] if row else []
    rows = docs.select(F.col("doc_id").cast("long"), *own, F.col("text").cast("string"))
    return on_workers(rows, _fingerprint_batches, f"doc_id long, {'row long, ' if row else ''}fp long")


# --- tiles ---------------------------------------------------------------------------------
def _shifts(radius: int) -> list[list[int]]:
    """Changes of the population counts with a sum of at most `radius`, one of each opposite pair, none first."""
    found = [[]]
    for _ in range(PARTS):
        found = [s + [d] for s in found for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    return sorted(s for s in found if s >= [0] * PARTS)


def tiles_of(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tiles `(counts, tile, fps)` of distinct fingerprints `fp`, and `(counts, n_tiles)`.

    A cell holds the fingerprints with the same population counts in all parts. It is cut by a hash into tiles of
    about TILE fingerprints, however many share the cell.
    """
    mask = (1 << WIDTH) - 1
    counts = F.array(*(F.bit_count(F.shiftrightunsigned("fp", WIDTH * p).bitwiseAND(F.lit(mask))) for p in range(PARTS)))
    placed = keys.select("fp", counts.alias("counts"))
    cells = placed.groupBy("counts").agg(F.ceil(F.count("*") / TILE).cast("int").alias("n_tiles"))
    tiles = (
        placed.join(cells, "counts")
        .withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("n_tiles")).cast("int"))
        .groupBy("counts", "tile")
        .agg(F.collect_list("fp").alias("fps"))
    )
    return tiles, cells


def tile_pairs(cells: DataFrame, radius: int) -> DataFrame:
    """Pairs of tiles whose population counts differ by at most the radius in all; the others can hold no link."""
    shifts = F.array(*(F.array(*map(F.lit, s)) for s in _shifts(radius)))
    near = cells.select("counts", "n_tiles", F.explode(shifts).alias("shift")).select(
        F.col("counts").alias("counts_a"),
        F.col("n_tiles").alias("n_a"),
        F.zip_with("counts", "shift", lambda c, s: c + s).alias("counts"),
    )
    near = near.join(cells, "counts").select(
        "counts_a", F.explode(F.sequence(F.lit(0), F.col("n_a") - 1)).alias("tile_a"),
        F.col("counts").alias("counts_b"), "n_tiles",
    )
    same = F.col("counts_a") == F.col("counts_b")
    first = F.when(same, F.col("tile_a")).otherwise(F.lit(0))
    return near.select("counts_a", "tile_a", "counts_b", F.explode(F.sequence(first, F.col("n_tiles") - 1)).alias("tile_b"))


def _forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) of a hit matrix that keep its components: all if they are few, else a search tree of each."""
    rows, columns = hit.shape
    if int(hit.sum()) <= rows + columns:
        return list(zip(*np.nonzero(hit)))
    links, seen = [], np.zeros(columns, bool)
    left = hit.any(1)
    while left.any():
        todo = [int(np.argmax(left))]
        left[todo[0]] = False
        while todo:
            row = todo.pop()
            fresh = np.nonzero(hit[row] & ~seen)[0]
            seen[fresh] = True
            for column in fresh:
                links.append((row, column))
                more = np.nonzero(hit[:, column] & left)[0]
                left[more] = False
                links.extend((r, column) for r in more)
                todo.extend(more.tolist())
    return links


def _compare(radius: int):
    def links_of(a: np.ndarray, b: np.ndarray, same: bool) -> list[tuple[int, int]]:
        hit = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
        if same:
            np.fill_diagonal(hit, False)
            hit = np.triu(hit) if hit.sum() <= 4 * len(a) else hit
        return [(a[i], b[j]) for i, j in _forest(hit)] if hit.any() else []

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for x, y, same in zip(batch["fps_a"], batch["fps_b"], batch["same"]):
                found += links_of(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64), same.as_py())
            links = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return compare


def near_links(keys: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links `(a, b)` that join all distinct fingerprints `fp` at `radius` or fewer differing bits into their classes.

    Within a pair of tiles, links that close a ring may be left out: classes stay whole, and no pair list of a large
    class is made.
    """
    tiles, cells = tiles_of(keys)
    tiles, cells = settle(tiles, "tiles"), settle(cells, "cells")
    side = lambda s: tiles.select(*(F.col(c).alias(f"{c}_{s}") for c in ("counts", "tile", "fps")))
    pairs = tile_pairs(cells, radius).join(side("a"), ["counts_a", "tile_a"]).join(side("b"), ["counts_b", "tile_b"])
    same = (F.col("counts_a") == F.col("counts_b")) & (F.col("tile_a") == F.col("tile_b"))
    return on_workers(pairs.select("fps_a", "fps_b", same.alias("same")), _compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, row: str | None = None) -> DataFrame:
    """`(doc_id, fp, component_id)` of every row of `docs`.

    Rows link at `radius` or fewer differing bits; component_id is the smallest doc_id reachable over links, the
    row's own included. Rows with equal fingerprints (repeated rows, copies, empty and null texts, all with
    fingerprint zero) are one node. A null doc_id stays in its class and never names it unless the class has no
    other; columns besides doc_id and text are ignored; no rows give no rows.

    With `row`, a column of unique whole numbers, `row` and `kept` are returned too: exactly one row of each class is
    kept, the one with the smallest doc_id, null last, then the least number.
    """
    marked = settle(fingerprints(docs, row), "fingerprints")
    first = [F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")).alias("first")] if row else []
    nodes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), *first), "nodes")
    roots = components(near_links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    classed = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), *(["first"] if row else []))
    names = classed.groupBy("root").agg(F.min("least").alias("component_id"), *([F.min("first").alias("first")] if row else []))
    if row:
        named = classed.join(names.withColumnRenamed("first", "of_class"), "root").select("fp", "component_id", F.col("of_class.row").alias("keep_row"))
        return marked.join(named, "fp").select("doc_id", "fp", "component_id", "row", (F.col("row") == F.col("keep_row")).alias("kept"))
    return marked.join(classed.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
