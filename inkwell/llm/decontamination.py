"""Benchmark decontamination: SimHash of item-sized windows, multi-index lookup, exact similarity."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import held, on_workers, settle, slices, table, texts_of

SHINGLE = 5
SIMILARITY = 0.8
#: At a similarity of 0.8 about 10 of 64 bits differ, with a deviation of 3.
RADIUS = 20
#: Blocks of a fingerprint. One of them differs in at most RADIUS // BLOCKS bits if all do in at most RADIUS.
BLOCKS = 7
#: Items, and bytes of their texts, that are looked for in one pass over the documents; more take more passes.
PASS_ITEMS = 20_000
PASS_BYTES = 32 << 20
KEPT = 400_000
#: Longer words are hashed each time, so that what is kept has a bound in bytes.
KEPT_BYTES = 64

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_EDGES = [64 * b // BLOCKS for b in range(BLOCKS + 1)]
_FILTER_BITS = 20


def _code(word: bytes) -> int:
    return zlib.crc32(word) | zlib.crc32(word[::-1] + b"#") << 32


class Codes(dict):
    """Codes of words; short ones are kept, KEPT at most."""

    def __missing__(self, word: bytes) -> int:
        code = _code(word)
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT:
                self.clear()
            self[word] = code
        return code


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered."""
    return text.encode().lower().split()


def shingles_of(words: list[bytes]) -> list[tuple[bytes, ...]]:
    """Runs of SHINGLE words, repeats included; all words if they are fewer."""
    return [tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []


def hashes_of(words: list[bytes], known: Codes, run: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each run of `run` words, SHINGLE at most; of all words if they are fewer."""
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(min(1, len(words)), len(words) - run + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(min(run, len(words))):
            total ^= (codes[j : j + n] * _ODD[j]) >> np.uint64(7) ^ codes[j : j + n] * _ODD[j - 1]
            total *= _ODD[0]
        total ^= total >> np.uint64(29)
        return total * _ODD[4]


def window_fingerprints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of `size` shingles at `starts`: bits that over half of them set."""
    low, high = int(starts.min()), int(starts.max()) + size
    bits = np.unpackbits(hashes[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    counts = sums[starts - low + size] - sums[starts - low]
    return np.packbits(counts * 2 > size, axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags of shingles, each weighing as often as it occurs."""
    return sum((a & b).values()) / max(1, sum((a | b).values()))


class Hit(NamedTuple):
    item_id: int
    first: int
    size: int
    similarity: float


class Index:
    """Items by length: their fingerprints under each block's values, and by shingle. Items of fewer words than a
    shingle by these words."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, least: float = SIMILARITY):
        self.radius, self.least, self.codes = radius, least, Codes()
        self.ids, self.lengths, self.bags, prints = [], [], [], []
        self.by_shingle: dict[int, list[int]] = {}
        short: dict[int, dict[int, list[tuple[list[bytes], int | None, int]]]] = {}
        for number, (item_id, text) in enumerate(items):
            words = words_of(text)
            if not words:
                continue
            hashes = hashes_of(words, self.codes)
            if len(words) < SHINGLE:
                short.setdefault(len(words), {}).setdefault(int(hashes[0]), []).append((words, item_id, number))
                continue
            for h in set(hashes.tolist()):
                self.by_shingle.setdefault(h, []).append(len(self.ids))
            self.ids.append(item_id)
            self.lengths.append(len(words))
            self.bags.append(Counter(shingles_of(words)))
            prints.append(int(window_fingerprints(hashes, np.zeros(1, np.int64), len(hashes))[0]))
        self.prints = np.array(prints, np.uint64)
        self.short = [(length, np.fromiter(by_hash, np.uint64, len(by_hash)), by_hash) for length, by_hash in sorted(short.items())]
        # A bit for each value of the leading bits; few other shingles pass.
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[[h >> (64 - _FILTER_BITS) for h in self.by_shingle]] = True
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        for i, length in enumerate(self.lengths):
            blocks = self.tables.setdefault(length, [{} for _ in range(BLOCKS)])
            for block, value in zip(blocks, self._blocks(prints[i])):
                block.setdefault(value, []).append(i)
        # Items that differ from a block's value in few enough bits, noted when first asked for.
        self.probed: dict[tuple[int, int, int], frozenset[int]] = {}
        self.flips = [
            [sum(1 << b for b in bits) for n in range(radius // BLOCKS + 1) for bits in itertools.combinations(range(to - at), n)]
            for at, to in itertools.pairwise(_EDGES)
        ]

    @staticmethod
    def _blocks(fingerprint: int) -> list[int]:
        return [fingerprint >> at & ((1 << (to - at)) - 1) for at, to in itertools.pairwise(_EDGES)]

    def near(self, fingerprint: int, length: int) -> list[int]:
        """All items of that length within the radius."""
        found = set()
        for n, value in enumerate(self._blocks(fingerprint)):
            key = (length, n, value)
            if key not in self.probed:
                block = self.tables[length][n]
                self.probed[key] = frozenset(i for flip in self.flips[n] for i in block.get(value ^ flip, ()))
            found |= self.probed[key]
        return sorted(i for i in found if (int(self.prints[i]) ^ fingerprint).bit_count() <= self.radius)

    def _short_hits(self, words: list[bytes]) -> Iterator[tuple[int, Hit]]:
        """Runs of words that are a whole item of fewer words than a shingle, with the number of the item."""
        for length, hashes, by_hash in self.short:
            if length <= len(words):
                runs = hashes_of(words, self.codes, length)
                for place in np.flatnonzero(np.isin(runs, hashes)).tolist():
                    for own, item_id, number in by_hash[int(runs[place])]:
                        if words[place : place + length] == own:
                            yield number, Hit(item_id, place, length, 1.0)

    def search(self, text: str) -> list[Hit]:
        """The best window of each item found in a text: most similar, then first.

        A window that shares no shingle with an item can't be similar to it, so windows are only made around places
        where a shingle of an item stands. An item of fewer words than a shingle is one, and stands where its words do.
        """
        words = words_of(text)
        if not words:
            return []
        hashes = hashes_of(words, self.codes)
        places = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - _FILTER_BITS)])
        around: dict[int, set[int]] = {}
        for place in places.tolist():
            for i in self.by_shingle.get(int(hashes[place]), ()):
                length = min(self.lengths[i], len(words))
                last = max(0, min(place, len(words) - length))
                first = max(0, place - max(1, length - SHINGLE + 1) + 1)
                around.setdefault(self.lengths[i], set()).update(range(min(first, last), last + 1))
        best: dict[int, Hit] = {}
        for length, wanted in around.items():
            size = min(length, len(words))
            # Bounded steps: the bits of a long run are never held at once.
            ordered = np.array(sorted(wanted), np.int64)
            for starts in np.split(ordered, np.flatnonzero(np.diff(ordered // 4096)) + 1):
                prints = window_fingerprints(hashes, starts, max(1, size - SHINGLE + 1))
                for start, own in zip(starts.tolist(), prints.tolist()):
                    near = self.near(own, length)
                    bag = Counter(shingles_of(words[start : start + size])) if near else None
                    for i in near:
                        alike = similarity(bag, self.bags[i])
                        if alike >= self.least and (i not in best or alike > best[i].similarity):
                            best[i] = Hit(self.ids[i], start, size, alike)
        short: dict[int, Hit] = {}
        for number, hit in self._short_hits(words):
            short.setdefault(number, hit)
        return sorted([*best.values(), *short.values()], key=lambda h: (h.item_id is not None, h.item_id or 0, h.first))


def index_of(items: list[tuple[int, str]]) -> Index:
    """The index of a block; a worker keeps the last one."""
    return held(("items", *items), lambda: Index(items))


def item_passes(items: DataFrame, limit: int = PASS_ITEMS, size: int = PASS_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The distinct (item_id, text) in blocks of about `limit` items and `size` bytes, or a longer one alone; the driver
    collects a block when it is asked for."""
    rows = items.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    n = max(1, math.ceil(count / limit), math.ceil(total / size))
    for block in range(n):
        yield [(r.item_id, r.text) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`(doc_id, item_id, first_word, n_words, start, end, similarity)`: items found in documents, by their best window.

    Words end at ASCII white space, and A-Z count as a-z. A window as long as an item (or the whole document,
    if that is shorter) leaks it if its weighted Jaccard similarity of five-word shingles is 0.8 or more; fewer words
    are one shingle. `start` and `end` are characters. Documents and items without words leak nothing; repeated
    documents give repeated rows, repeated items one; different texts of one item_id are items of their own, also where it
    is null; null ids are carried; other columns are ignored; no rows give no
    rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, first_word long, n_words long, start long, end long, similarity double"
    found = None
    for block in item_passes(items):

        def batches(given: Iterable[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = index_of(block)
            for batch in slices(given):
                hits = []
                for doc_id, text in zip(batch["doc_id"].to_pylist(), texts_of(batch["text"])):
                    if own := index.search(text):
                        data = text.encode()
                        spans = [m.span() for m in _WORDS.finditer(data)]
                        for h in own:
                            start, end = spans[h.first][0], spans[h.first + h.size - 1][1]
                            before, inside = len(data[:start].decode()), len(data[start:end].decode())
                            hits.append((doc_id, h.item_id, h.first, h.size, before, before + inside, h.similarity))
                columns = list(zip(*hits)) if hits else [[]] * 7
                kinds = [pa.int64()] * 6 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "first_word", "n_words", "start", "end", "similarity"])

        # Hits are written before the next block is collected, so neither plan nor driver gathers blocks.
        one = settle(on_workers(rows, batches, schema), "leaks")
        found = one if found is None else found.unionByName(one)
    return found


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
