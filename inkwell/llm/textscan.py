"""Whole texts as bytes in numpy: words, lines and character counts of many documents at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space, in either form.
WHITE_BYTES = b" \t\n\x0b\x0c\r"
#: Bytes of text that are looked at together; a longer text is looked at alone.
BLOCK = 1 << 22


def class_of(members: bytes) -> np.ndarray:
    """For every byte whether it is a member."""
    held = np.zeros(256, bool)
    held[list(members)] = True
    return held


IS_WHITE = class_of(WHITE_BYTES)
#: Bytes that begin a code point.
IS_FIRST = np.array([b & 0xC0 != 0x80 for b in range(256)])


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of about BLOCK bytes of text, at least one row each."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + BLOCK, side="right")))
            yield batch.slice(start, end - start)
            start = end


def codes(values: pa.Array) -> np.ndarray:
    """Equal values get equal numbers, from 0 on."""
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def groups_of(numbers: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document, how many different numbers it has; `numbers` come from `paired` with the document."""
    owner = np.zeros(int(numbers.max()) + 1 if len(numbers) else 0, np.int64)
    owner[numbers] = doc
    return np.bincount(owner, minlength=n)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of pairs of numbers."""
    return codes(pa.array(a * (int(b.max()) + 1 if len(b) else 1) + b))


class Texts:
    """The texts of an Arrow column; null counts as empty. Words are runs without the bytes `between`."""

    def __init__(self, column: pa.Array, between: np.ndarray = IS_WHITE):
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        self.n = len(texts)
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        self.at = ends - ends[0]
        self.solid = ~between[self.data]
        first = self.solid.copy()
        first[1:] &= ~self.solid[:-1]
        starts = self.at[:-1][self.at[:-1] < self.at[1:]]
        first[starts] = self.solid[starts]
        #: Where words begin, which document each is in, and where each document's words begin.
        self.starts = np.flatnonzero(first)
        self.word_at = np.searchsorted(self.starts, self.at)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.word_at))
        self._words: np.ndarray | None = None

    def count(self, held: np.ndarray) -> np.ndarray:
        """Per document, how many bytes are marked in `held` (one mark per byte of the texts)."""
        return np.diff(np.concatenate([[0], np.cumsum(held)])[self.at])

    def n_words(self) -> np.ndarray:
        return np.diff(self.word_at)

    def _parts(self, kept: np.ndarray, starts: np.ndarray) -> pa.Array:
        """Byte strings that begin at `starts`, of the kept bytes only."""
        before = np.concatenate([[0], np.cumsum(kept)])
        ends = np.append(before[starts], before[-1]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(self.data[kept])])

    def parts(self) -> pa.Array:
        """All words as byte strings."""
        return self._parts(self.solid, self.starts)

    def words(self) -> np.ndarray:
        """A number per word; equal words of one document have equal ones, words of different documents never."""
        if self._words is None:
            self._words = paired(codes(self.parts()), self.doc)
        return self._words

    def n_distinct(self) -> np.ndarray:
        """Distinct words of each document."""
        return groups_of(self.words(), self.doc, self.n)

    def repeated_words(self, size: int) -> np.ndarray:
        """Words of each document that lie in windows of `size` words found twice or more in it."""
        words = self.words()
        run, length = words, 1
        while length < size:
            step = min(length, size - length)
            # A window is the run at its start and the run that ends with it.
            run = paired(run[:-step], run[step:]) if len(run) > step else run[:0]
            length += step
        inside = np.flatnonzero(self.doc[: len(run)] == self.doc[size - 1 : size - 1 + len(run)])
        seen = codes(pa.array(run[inside]))
        again = inside[np.bincount(seen)[seen] > 1] if len(seen) else inside
        edge = np.bincount(again, minlength=len(words) + 1) - np.bincount(again + size, minlength=len(words) + 1)
        return np.bincount(self.doc[np.cumsum(edge)[:-1] > 0], minlength=self.n)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Per document, its lines that hold a word, and those of them that are equal to an earlier one."""
        breaks = self.data == 10
        starts = np.sort(np.concatenate([self.at[:-1], np.flatnonzero(breaks) + 1]))
        starts = starts[starts <= len(self.data)]
        solid = np.concatenate([[0], np.cumsum(self.solid)])
        full = np.diff(solid[np.append(starts, len(self.data))]) > 0
        numbers = codes(self._parts(~breaks, starts))[full]
        doc = np.searchsorted(self.at, starts[full], side="right") - 1
        n = np.bincount(doc, minlength=self.n)
        return n, n - groups_of(paired(numbers, doc), doc, self.n)
