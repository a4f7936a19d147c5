"""BPE encoding and decoding: one pass of dynamic programming over the prefixes of a word."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkwell.llm.common import held, on_workers, ragged, slices, table, texts_of

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Words, pieces and pairs of tokens whose results a worker keeps, about.
KEPT = 100_000
#: Longer words and pieces are worked out each time, so that what is kept has a bound in bytes.
KEPT_CHARS = 64
#: Stands for the word end; private use, so no byte letter.
_END = "\ue000"

#: The pre-tokenizer's pattern; for texts below U+0250 both libraries know the same letters.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: ASCII that stands for itself as a byte letter; control characters do not.
_PLAIN = re.compile("[^\x1c-\x1f\u0250-\U0010ffff]*")
_ASCII_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
#: Characters that Python takes for white space and the pre-tokenizer does not.
_NO_SPACE = re.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it is printable in Latin-1, else the next one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Recent:
    """The last KEPT results and those before them, at most as many again."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, key: str, make) -> bytes:
        """The result for a key that `new` doesn't have."""
        found = self.old.get(key)
        if found is None:
            found = make(key)
        if len(key) > KEPT_CHARS:
            return found
        if len(self.new) >= KEPT:
            self.old, self.new = self.new, {}
        self.new[key] = found
        return found


class PrefixEncoder:
    """Encodes words of a BPE vocabulary whose words end with a suffix.

    For every prefix of a word, the last token of its encoding is unique. It is the token that ends there and that
    the last token of what precedes it can stand before, meaning that no merge would have joined across the two.
    Tokens that end at a place come from an automaton of the vocabulary; back-pointers then give the ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model = parts["model"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.ids = model["vocab"]
        lacking = [x for x in byte_letters().values() for end in ("", suffix) if x + end not in self.ids]
        if lacking:
            raise ValueError(f"{path}: no token for the bytes {lacking}, so not every text has an encoding")
        marked = lambda t: t[: -len(suffix)] + _END if suffix and t.endswith(suffix) else t
        self.merges: dict[tuple[int, int], int] = {}
        # Of each token: the step that makes it, and what it is made of; -1 for single letters.
        self.step = dict.fromkeys(self.ids.values(), -1)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        for n, (a, b) in enumerate(model["merges"]):
            x, y, made = self.ids[a], self.ids[b], self.ids[a + b]
            if (x, y) not in self.merges:
                self.merges[x, y] = n
            if made not in self.left:
                self.step[made], self.left[made], self.right[made] = n, x, y
        self._automaton({marked(t): i for t, i in self.ids.items()})
        self.pairs: dict[int, bool] = {}
        self.pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.words = Recent()
        self.chunks = Recent()

    def _automaton(self, tokens: dict[str, int]) -> None:
        """Of each state: the next states by letter, and the tokens that end there, longest first, with their letters."""
        self.next: list[dict[str, int]] = [{}]
        own: list[tuple[int, int] | None] = [None]
        for token, i in tokens.items():
            letters = len(token) - token.endswith(_END)
            # A token that merges cannot make ends no prefix.
            if letters > 1 and i not in self.left:
                continue
            state = 0
            for letter in token:
                if letter not in self.next[state]:
                    self.next[state][letter] = len(self.next)
                    self.next.append({})
                    own.append(None)
                state = self.next[state][letter]
            own[state] = (i, letters)
        self.shorter = [0] * len(self.next)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        todo = [(0, letter, state) for letter, state in self.next[0].items()]
        for parent, letter, state in todo:
            if parent:
                self.shorter[state] = self._step(self.shorter[parent], letter)
            self.ends[state] = (*((own[state],) if own[state] else ()), *self.ends[self.shorter[state]])
            todo += [(state, following, child) for following, child in self.next[state].items()]

    def _step(self, state: int, letter: str) -> int:
        while letter not in self.next[state] and state:
            state = self.shorter[state]
        return self.next[state].get(letter, 0)

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of a's text followed by b's is a, b."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        # Merges are taken back from the last to the first; those that met at the border decide.
        never = len(self.merges) + 1
        until_a = until_b = never
        while True:
            step = self.merges.get((a, b))
            # Of equal steps the left one comes first.
            if step is not None and step < until_a and step <= until_b:
                return False
            if self.step[a] > self.step[b]:
                until_a, a = self.step[a], self.right[a]
            elif self.step[b] >= 0:
                until_b, b = self.step[b], self.left[b]
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word in byte letters."""
        n, state, known, follow, ends = len(word), 0, self.pairs.get, self.next, self.ends
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for at, letter in enumerate(word, 1):
            following = follow[state].get(letter)
            if following is None:
                # Steps that fall back to a shorter suffix are noted with the others.
                following = follow[state][letter] = self._step(state, letter)
            state = following
            if at == n:
                # The end mark belongs to the last letter.
                state = self._step(state, _END)
            for token, letters in ends[state]:
                start = at - letters
                if not start:
                    last[at] = token
                    break
                before = last[start]
                fit = known(before << 32 | token)
                if self.fits(before, token) if fit is None else fit:
                    last[at], back[at] = token, start
                    break
        found, at = [], n
        while at:
            found.append(last[at])
            at = back[at]
        return found[::-1]

    def _words(self, chunk: str) -> list[str]:
        if chunk.isascii() and chunk.isprintable():
            # Letters alone are one word.
            low = chunk.lower()
            return [low] if low.isalpha() else _ASCII_WORDS.findall(low)
        if _PLAIN.fullmatch(chunk):
            words = _WORDS.findall(chunk.lower())
            return [w.encode().decode("latin-1").translate(self.letters) for w in words]
        normal = self.library.normalizer.normalize_str(chunk)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _word(self, word: str) -> bytes:
        return array("i", self.encode_word(word)).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        words = self._words(chunk)
        if len(words) == 1:
            return self.words.new.get(words[0]) or self.words.find(words[0], self._word)
        return b"".join([self.words.new.get(w) or self.words.find(w, self._word) for w in words])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        sections = self.pattern.split(text) if self.pattern and "<|" in text else [text]
        parts: list[bytes] = []
        recent = self.chunks
        for n, section in enumerate(sections):
            if n % 2:
                parts.append(np.array([self.special[section]], "<i4").tobytes())
                continue
            for chunk in _ASCII_SPACE.split(section) if _NO_SPACE.search(section) else section.split():
                parts.append(recent.new.get(chunk) or recent.find(chunk, self._chunk))
        return np.frombuffer(b"".join(parts), "<i4")


class Decoder:
    """The tokens of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.text = {i: t for t, i in parts["model"]["vocab"].items()} | {t["id"]: t["content"] for t in parts["added_tokens"]}

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens with a space between, special ones included; ids unknown to the vocabulary vanish."""
        return " ".join(filter(None, map(self.text.get, ids)))


def encoder(path: str) -> PrefixEncoder:
    """One encoder per worker and vocabulary."""
    return held(("bpe", path), lambda: PrefixEncoder(path))


def decoder(path: str) -> Decoder:
    return held(("bpe tokens", path), lambda: Decoder(path))


def codec(path: str) -> tuple[PrefixEncoder, Decoder]:
    """Both directions, kept together."""
    return held(("bpe codec", path), lambda: (PrefixEncoder(path), Decoder(path)))


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """`(doc_id, ids)` of every row of `docs`, as the tokenizers library encodes without special tokens added.

    A null text counts as empty and has no ids; strings of special tokens in a text become those tokens. Rows are
    independent, so ties and repeats don't matter; other columns are ignored; no rows give no rows.
    """

    def batches(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in slices(given):
            ids = ragged([own.encode(t) for t in texts_of(batch["text"])], pa.int32())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], ids], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return on_workers(rows, batches, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """`(doc_id, ids, decoded)` of every row; null ids count as none, null and unknown ids in a list vanish."""

    def batches(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(path)
        for batch in slices(given):
            texts = [own.decode(ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else ()) for ids in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return on_workers(encoded.select("doc_id", "ids"), batches, "doc_id long, ids array<int>, decoded string")


def recode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """`decode(encode(docs))` in one pass."""

    def batches(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, back = codec(path)
        for batch in slices(given):
            ids = [there.encode(t) for t in texts_of(batch["text"])]
            texts = pa.array([back.decode(x.tolist()) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], ragged(ids, pa.int32()), texts], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return on_workers(rows, batches, "doc_id long, ids array<int>, decoded string")


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """`(doc_id, n_tokens, ids_sha256, decoded_sha256)` and `more` columns."""
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return decoded.select(
        "doc_id", *more, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(recode(table(spark, sf_dir, "documents")))
