"""Token ids in files of directly addressable codes: any id can be read without decoding a block."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkwell.llm.common import on_workers, settle, table
from inkwell.llm.textscan import blocks
from inkwell.session import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
#: Ids of a file, about; a document is never cut.
FILE_IDS = 1 << 23
#: Pieces of text whose ids a worker keeps, at most as many again until it drops those met longest ago; the longest one kept.
KEPT, KEPT_CHARS = 400_000, 64

MAGIC = b"DAC1"
#: Continuation bits between two entries of a rank directory.
RANK_BITS = 512

# --- encoding ------------------------------------------------------------------------------
#: Size of a word whose ids depend on the white space around it.
ODD = -1
#: Borders that pre-tokens never cross: before a single space between two other characters.
_BORDER = re.compile(r"(?<=\S)(?= \S)")


class Words:
    """Words with their ids as arrays: where those of each begin, how many there are, and when it was met last."""

    def __init__(self):
        self.words = pa.array([], pa.large_string())
        self.ids = np.zeros(0, "<u4")
        self.starts, self.sizes, self.met = (np.zeros(0, np.int64) for _ in range(3))
        self.turn = 0

    def places(self, words: pa.Array, learn) -> np.ndarray:
        """Where different words stand here; `learn` gives sizes and ids of those that don't yet, which are put last, long ones after all others."""
        self.turn += 1
        at = pc.index_in(words, value_set=self.words)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().astype(np.int64)
        self.met[at[known]] = self.turn
        new = np.flatnonzero(~known)
        new = new[np.argsort(pc.utf8_length(words.take(pa.array(new))).to_numpy() > KEPT_CHARS, kind="stable")]
        at[new] = len(self.words) + np.arange(len(new))
        added = words.take(pa.array(new))
        sizes, ids = learn(added.to_numpy(zero_copy_only=False).tolist())
        ends = np.cumsum(np.maximum(sizes, 0))
        self.starts = np.concatenate([self.starts, len(self.ids) + ends - np.maximum(sizes, 0)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.met = np.concatenate([self.met, np.full(len(new), self.turn)])
        self.ids = np.concatenate([self.ids, ids])
        self.words = pa.concat_arrays([self.words, added])
        return at

    def trim(self) -> None:
        """Drop long words, which stand last, and if there are too many those that were met longest ago."""
        long = pc.utf8_length(self.words).to_numpy() > KEPT_CHARS
        n = len(long) - int(long.sum())
        if n <= 2 * KEPT:
            if n < len(long):
                self.ids = self.ids[: self.starts[n]]
                self.words, self.starts, self.sizes, self.met = self.words[:n], self.starts[:n], self.sizes[:n], self.met[:n]
            return
        stay = np.sort(np.argsort(-self.met[:n], kind="stable")[:KEPT])
        n_ids = np.maximum(self.sizes[stay], 0)
        starts = np.cumsum(n_ids) - n_ids
        self.ids = self.ids[np.repeat(self.starts[stay] - starts, n_ids) + np.arange(n_ids.sum())]
        self.words, self.starts, self.sizes, self.met = self.words.take(pa.array(stay)), starts, self.sizes[stay], self.met[stay]


class PieceEncoder:
    """Encodes with the library, piece by piece between single spaces, and keeps the ids of pieces met before."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]
        (space,) = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(" ")]
        self.spaced = np.array([(self.library.id_to_token(i) or "").startswith(space) for i in range(self.library.get_vocab_size())])
        self.known = Words()
        self.whole: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has with the space before it, ODD if it lies next to other white space; all these ids."""
        sizes = np.full(len(words), ODD)
        plain = [bool(w) and not w[0].isspace() and not w[-1].isspace() for w in words]
        if not any(plain):
            return sizes, np.zeros(0, "<u4")
        # In one text, since single calls cost more; each word's ids begin with one that has its space.
        (ids,) = self._encode([" " + " ".join(itertools.compress(words, plain))])
        places = np.flatnonzero(self.spaced[ids])
        assert len(places) == sum(plain)
        sizes[plain] = np.diff(places, append=len(ids))
        return sizes, ids

    def _by_border(self, text: str) -> bytes:
        pieces = _BORDER.split(text)
        new = list(set(pieces).difference(self.whole))
        self.whole |= zip(new, (x.tobytes() for x in self._encode(new)))
        found = b"".join(map(self.whole.__getitem__, pieces))
        for piece in new:
            if len(piece) > KEPT_CHARS:
                del self.whole[piece]
        if len(self.whole) > KEPT:
            self.whole.clear()
        return found

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow column, one after the other, and how many each text has.

        Texts are cut at single spaces as bytes; each different piece is looked up once, and the ids of all pieces are
        taken from a table of the different ones.
        """
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        parts = Pieces(texts)
        first = np.zeros(len(parts.starts), bool)
        first[parts.base[:-1]] = True
        # Pieces after a space.
        numbers, words = parts.different(~first)
        known = self.known
        places = known.places(words, self._learn)
        odd = known.sizes[places] == ODD
        # Texts that are not simply the sum of their pieces: with special tokens, or with a word beside other white space.
        special = np.zeros(len(texts), bool)
        for mark in self.special:
            special |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False).astype(bool)
        whole = np.zeros(len(texts), bool)
        whole[parts.doc[~first][odd[numbers]]] = True
        head_numbers, heads = parts.different(first)
        heads = heads.to_numpy(zero_copy_only=False).tolist()
        loose = np.array([h[-1:].isspace() for h in heads] or [False])
        whole |= loose[head_numbers] & (np.diff(parts.base) > 1)
        alone = np.flatnonzero(whole | special)
        own = [
            self._encode([t])[0].tobytes() if special[i] else self._by_border(t) for i, t in ((i, texts[i].as_py()) for i in alone.tolist())
        ]
        used = np.zeros(len(heads), bool)
        used[head_numbers[~(whole | special)]] = True
        entries = [*(self._by_border(h) if u else b"" for h, u in zip(heads, used)), *own, b""]
        at = np.empty(len(parts.starts), np.int64)
        at[~first], at[first] = places[numbers], len(known.words) + head_numbers
        at[(whole | special)[parts.doc]] = len(known.words) + len(entries) - 1
        at[parts.base[alone]] = len(known.words) + len(heads) + np.arange(len(alone))
        lengths = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        starts = np.concatenate([known.starts, len(known.ids) + np.cumsum(lengths) - lengths])
        n = np.concatenate([known.sizes, lengths])[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        table = np.concatenate([known.ids, np.frombuffer(b"".join(entries), "<u4")])
        known.trim()
        return table[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])], np.diff(ends[parts.base])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, n = self.encode_column(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if len(texts) else []


@functools.cache
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder per worker and vocabulary, so that a task begins with the words of those before it."""
    return PieceEncoder(path)


class Pieces:
    """Texts cut at every space: where each piece begins, which text it is of, and where each text's pieces begin."""

    def __init__(self, texts: pa.Array):
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        self.solid = self.data != 32
        before = np.concatenate([[0], np.cumsum(self.solid)])
        self.base = np.concatenate([[0], np.cumsum(1 + np.diff(at) - np.diff(before[at]))])
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.base))
        first = np.zeros(self.base[-1], bool)
        first[self.base[:-1]] = True
        self.starts = np.empty(self.base[-1], np.int64)
        self.starts[first] = at[:-1]
        self.starts[~first] = np.flatnonzero(~self.solid) + 1
        ends = np.append(before[self.starts], before[-1])
        held = pa.py_buffer(self.data[self.solid])
        self.pieces = pa.Array.from_buffers(pa.large_string(), len(self.starts), [None, pa.py_buffer(ends.astype(np.int64)), held])

    def different(self, held: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """The different ones among some pieces, and the number of each piece among them."""
        coded = self.pieces.filter(pa.array(held)).dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


# --- file format ---------------------------------------------------------------------------
def pack(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> bytes:
    """One file: ids split into levels of 8-bit chunks, lowest first.

    Level k holds a chunk of every id that has more than k of them, in id order; its bitmap says which ids go on to
    level k + 1, and its rank directory counts the ones before every RANK_BITS bits. `ends`: where each document ends.
    """
    parts, sections, at = [], {}, 0

    def put(name: str, values: np.ndarray) -> None:
        nonlocal at
        data = values.tobytes()
        sections[name] = [at, len(data)]
        parts.append(data)
        at += len(data)

    levels, rest = 0, ids.astype("<u4")
    while levels == 0 or len(rest):
        more = rest > 255
        ones = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK_BITS)))]) if len(more) else np.zeros(1)
        put(f"chunks{levels}", rest.astype(np.uint8))
        put(f"more{levels}", np.packbits(more, bitorder="little"))
        put(f"ranks{levels}", ones.astype("<u4"))
        rest, levels = rest[more] >> 8, levels + 1
    put("docs", np.array([d or 0 for d in doc_ids], "<i8"))
    put("known", np.packbits(np.array([d is not None for d in doc_ids], bool), bitorder="little"))
    put("ends", ends.astype("<u8"))
    head = json.dumps({"levels": levels, "ids": len(ids), "docs": len(doc_ids), "sections": sections}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])


class TokenFile:
    """Reads one file by place; only the bytes that are asked for are read."""

    def __init__(self, path: str):
        store, own = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(own)
        if self.file.read_at(4, 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        (size,) = struct.unpack("<I", self.file.read_at(4, 4))
        head = json.loads(self.file.read_at(size, 8))
        self.base, self.levels, self.n_ids, self.n_docs = 8 + size, head["levels"], head["ids"], head["docs"]
        self.sections = head["sections"]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def _read(self, name: str, kind: str, first: int, n: int) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return np.frombuffer(self.file.read_at(n * width, self.base + self.sections[name][0] + first * width), kind)

    def _bits(self, name: str, first: int, end: int) -> np.ndarray:
        start = first // 8
        data = self._read(name, "u1", start, (end + 7) // 8 - start)
        return np.unpackbits(data, bitorder="little")[first - 8 * start : end - 8 * start]

    def _rank(self, level: int, at: int) -> int:
        """Ones before a place of a level's bitmap."""
        block = at // RANK_BITS
        before = int(self._read(f"ranks{level}", "<u4", block, 1)[0])
        return before + int(self._bits(f"more{level}", block * RANK_BITS, at).sum())

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids first to end - 1. Those of a run that go on are a run in the next level again."""
        found = np.zeros(end - first, "<u4")
        where, level = np.arange(end - first), 0
        while len(where):
            found[where] |= self._read(f"chunks{level}", "u1", first, end - first).astype("<u4") << (8 * level)
            more = self._bits(f"more{level}", first, end).astype(bool)
            if not more.any():
                break
            first = self._rank(level, first)
            where, level = where[more], level + 1
            end = first + len(where)
        return found

    def token(self, at: int) -> int:
        return int(self.ids(at, at + 1)[0])

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents and where each ends."""
        docs, known = self._read("docs", "<i8", 0, self.n_docs), self._bits("known", 0, self.n_docs)
        return [int(d) if k else None for d, k in zip(docs, known)], self._read("ends", "<u8", 0, self.n_docs).astype(np.int64)


# --- Spark ---------------------------------------------------------------------------------
def write_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode `docs` and write token files below `path`; returns the stored list `(part, file, path, docs, ids)`.

    Documents are in ascending doc_id order within and across files, null first; rows that repeat a doc_id follow
    each other. Each document ends with the id END_ID; a null text is the end alone. Other columns are ignored; no
    rows make no file. A task that runs again writes files of new names, and the list names those of the runs that
    count.
    """

    def batches(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, n = piece_encoder(vocabulary), TaskContext.get().partitionId(), 0
        store, folder = fs.FileSystem.from_uri(path)
        names: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal n
            name = f"{part:06d}-{n:06d}-{uuid.uuid4().hex}.dac"
            ids, ends = np.concatenate(held), np.cumsum(np.concatenate(lengths))
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/{name}") as file:
                file.write(pack(names, ids, ends))
            row = [[part], [n], [f"{path}/{name}"], [len(names)], [len(ids)]]
            n += 1
            for x in (names, held, lengths):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(v) for v in row], ["part", "file", "path", "docs", "ids"])

        waiting = 0
        for batch in blocks(given):
            ids, own = encoder.encode_column(batch["text"])
            ended = np.full(len(ids) + len(own), END_ID, "<u4")
            ended[np.arange(len(ids)) + np.repeat(np.arange(len(own)), own)] = ids
            names.extend(batch["doc_id"].to_pylist())
            held.append(ended)
            lengths.append(own + 1)
            waiting += len(ended)
            if waiting >= file_ids:
                waiting = 0
                yield flush()
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # The source partition parts rows that repeat one id.
    sorted_rows = rows.repartitionByRange("doc_id", F.spark_partition_id()).sortWithinPartitions("doc_id")
    schema = "part long, file long, path string, docs long, ids long"
    return settle(on_workers(sorted_rows, batches, schema), "token-files")


def read_files(files: DataFrame, block: int = 1 << 20) -> DataFrame:
    """`(doc_id, start, n_tokens, ids_crc32)` of every document in listed files, from the files."""

    def batches(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for path, before in zip(batch["path"].to_pylist(), batch["before"].to_pylist()):
                with TokenFile(path) as file:
                    docs, ends = file.documents()
                    starts, sums, at = np.concatenate([[0], ends[:-1]]), [], 0
                    while at < len(docs):
                        # Whole documents of about a block, at least one.
                        to = max(at + 1, int(np.searchsorted(ends, starts[at] + block, side="right")))
                        ids = file.ids(int(starts[at]), int(ends[to - 1]))
                        for a, b in zip(starts[at:to] - starts[at], ends[at:to] - starts[at]):
                            sums.append(zlib.crc32(ids[a:b].tobytes()))
                        at = to
                columns = [pa.array(docs, pa.int64()), pa.array(starts + before), pa.array(ends - starts), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = files.count()
    # One row per file: the only thing that is summed along all files.
    order = Window.orderBy("part", "file")
    placed = files.withColumn("before", F.sum("ids").over(order) - F.col("ids"))
    spread = placed.repartition(max(1, n), "path").select("path", "before")
    return on_workers(spread, batches, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(write_files(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens")))
