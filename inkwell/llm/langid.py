"""Language identification, word first: frequencies of known words, character n-grams for the others."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import fold, on_workers, settle, table
from inkwell.llm.textscan import Texts, blocks, class_of

MODULUS, HELD = 5, 0
#: The model's size, at most: words and n-grams, those with the highest share in any language.
WORDS, GRAMS = 60_000, 60_000
ORDERS = (5, 4, 3, 2, 1)
#: Words with a letter more than this are known by n-grams only.
WORD_CHARS = 40
#: Places of a word at which n-grams are cut in one go.
STEP = 64
KEPT = 200_000
UNKNOWN = "und"

#: Runs of letters, as in training.
_WORDS = regex.compile(r"\p{L}+")
#: ASCII that no word holds.
_BETWEEN = class_of(bytes(b for b in range(128) if not chr(b).isalpha()))


# --- training ------------------------------------------------------------------------------
def word_counts(docs: DataFrame) -> DataFrame:
    """`(word, lang, n)` over all documents of known language outside the held-out fold."""
    rows = docs.where(F.col("lang").isNotNull() & (fold(MODULUS) != HELD)).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.groupBy("word", "lang").agg(F.count("*").alias("n"))


def _most_telling(counts: DataFrame, key: str, totals: DataFrame, limit: int) -> list:
    """The `limit` keys with the highest share in any language, with their count in each."""
    shares = counts.join(F.broadcast(totals), "lang")
    entry = F.struct("lang", "n")
    ranked = shares.groupBy(key).agg(F.max(F.col("n") / F.col("total")).alias("peak"), F.collect_list(entry).alias("of"))
    return ranked.orderBy(F.desc("peak"), key).limit(limit).collect()


class Model(NamedTuple):
    """Log frequencies of words and n-grams, one row each, one column per language in order."""

    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray
    #: Tells this model from others.
    name: str = ""


def _logs(rows: list, key: str, langs: list[str], totals: dict[str, int]) -> tuple[dict[str, int], np.ndarray]:
    column = {lang: i for i, lang in enumerate(langs)}
    logs = np.zeros((len(rows), len(langs)))
    for i, row in enumerate(rows):
        for lang, n in row["of"]:
            logs[i, column[lang]] = n
    smooth = 0.5
    size = np.array([totals[lang] for lang in langs]) + smooth * max(1, len(rows))
    return {row[key]: i for i, row in enumerate(rows)}, np.log((logs + smooth) / size).astype(np.float32)


def _totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang").agg(F.sum("n").alias("total"))


def train(docs: DataFrame, words: int = WORDS, grams: int = GRAMS) -> Model:
    """Model from the words of all training documents.

    N-grams are counted over all training words of any length, each as often as the word occurs.
    The driver gets the languages and at most `words` and `grams` rows.
    """
    counts = settle(word_counts(docs), "word-counts")
    totals = settle(_totals(counts), "word-totals")
    by_lang = {r.lang: r.total for r in totals.collect()}
    langs = sorted(by_lang)
    if not langs:
        return Model([], {}, np.zeros((0, 0), np.float32), {}, np.zeros((0, 0), np.float32))
    known = _most_telling(counts.where(F.length("word") <= WORD_CHARS), "word", totals, words)
    marked = counts.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("word"), "lang", "n")
    # Long words in parts that overlap, so that the cost follows their length.
    part_starts = F.sequence(F.lit(1), F.length("word"), F.lit(STEP))
    parts = marked.select("lang", "n", F.explode(F.transform(part_starts, lambda i: F.substring("word", i, F.lit(STEP + max(ORDERS) - 1)))).alias("part"))
    starts = F.sequence(F.lit(1), F.least(F.length("part"), F.lit(STEP)))
    # A second parameter of the inner function would be taken for the index of the element.
    of_order = lambda o: F.transform(starts, lambda i: F.substring("part", i, F.lit(o)))
    cut = F.flatten(F.array(*map(of_order, ORDERS)))
    # Near the end, shorter pieces repeat those of lower orders; each string counts once per part.
    pieces = parts.select("lang", "n", F.explode(F.array_distinct(cut)).alias("gram"))
    gram_counts = settle(pieces.groupBy("gram", "lang").agg(F.sum("n").alias("n")), "gram-counts")
    gram_rows = _most_telling(gram_counts, "gram", _totals(gram_counts), grams)
    gram_totals = {r.lang: r.total for r in _totals(gram_counts).collect()}
    return Model(langs, *_logs(known, "word", langs, by_lang), *_logs(gram_rows, "gram", langs, gram_totals), uuid.uuid4().hex)


# --- prediction ----------------------------------------------------------------------------
class Grams:
    """Known n-grams as a tree over their letters, looked up at all places of many words at a time."""

    def __init__(self, model: Model):
        letters = sorted({ord(c) for g in model.grams for c in g})
        self.letters = pd.Index(np.array(letters, np.int64))
        self.width = len(letters) + 1
        self.logs = model.gram_logs.astype(np.float64)
        # Of every length: the nodes by (node before, letter), and the n-gram that ends there, if any.
        self.nodes: list[pd.Index] = []
        self.rows: list[np.ndarray] = []
        before = {"": 0}
        for length in range(1, max(ORDERS) + 1):
            heads = sorted({g[:length] for g in model.grams if len(g) >= length})
            keys = [before[h[:-1]] * self.width + int(self.letters.get_loc(ord(h[-1]))) for h in heads]
            self.nodes.append(pd.Index(np.array(keys, np.int64)))
            self.rows.append(np.array([model.grams.get(h, -1) for h in heads], np.int64))
            before = {h: i for i, h in enumerate(heads)}

    def scores(self, words: list[str]) -> np.ndarray:
        """Per word the mean over its longest n-grams that are known at all; zeros if none is."""
        n, width = len(words), self.logs.shape[1]
        found, open_words = np.zeros((n, width)), np.ones(n, bool)
        marked = [f"^{w}$" for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, n)
        of = np.repeat(np.arange(n), sizes)
        # Letters left in the word from each place on.
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(of))
        codes = self.letters.get_indexer(np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.int64))
        node, at_length = np.zeros(len(of), np.int64), []
        for length, (nodes, rows) in enumerate(zip(self.nodes, self.rows), 1):
            here = np.flatnonzero((node >= 0) & (left >= length))
            here = here[codes[here + length - 1] >= 0]
            following = nodes.get_indexer(node[here] * self.width + codes[here + length - 1])
            node = np.full(len(of), -1, np.int64)
            node[here] = following
            here = here[following >= 0]
            known = rows[node[here]]
            at_length.append((of[here][known >= 0], known[known >= 0]))
        for length in ORDERS:
            word, row = at_length[length - 1]
            word, row = word[open_words[word]], row[open_words[word]]
            count = np.bincount(word, minlength=n)
            for k in range(width):
                found[:, k] += np.bincount(word, weights=self.logs[row, k], minlength=n) / np.maximum(count, 1)
            open_words &= count == 0
        return found


class Scorer:
    """Scores texts by a model; keeps the log frequencies of unseen words met before."""

    def __init__(self, model: Model):
        self.model = model
        self.grams = Grams(model) if model.langs else None
        self.unseen: dict[str, np.ndarray] = {}

    def _learn(self, words: set[str]) -> dict[str, np.ndarray]:
        """Scores of words that the model doesn't hold; short ones are kept."""
        found = {w: self.unseen[w] for w in words if w in self.unseen}
        new = [w for w in words if w not in found]
        if new:
            scored = dict(zip(new, self.grams.scores(new)))
            found |= scored
            if len(self.unseen) >= KEPT:
                self.unseen.clear()
            self.unseen |= {w: x for w, x in scored.items() if len(w) <= WORD_CHARS}
        return found

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Languages and their posteriors for an Arrow column of texts, all languages being alike before.

        Texts are cut at ASCII characters other than letters; each different piece is scored once and the scores are
        added up by text.
        """
        texts = Texts(column, _BETWEEN)
        coded = texts.parts().dictionary_encode()
        numbers, tokens = coded.indices.to_numpy(zero_copy_only=False), [t.decode().lower() for t in coded.dictionary.to_pylist()]
        langs = self.model.langs
        logs, letters = np.zeros((len(tokens), len(langs))), np.ones(len(tokens), bool)
        at = np.array([self.model.words.get(t, -1) for t in tokens], np.int64)
        if langs:
            logs[at >= 0] = self.model.word_logs[at[at >= 0]]
        # Tokens that the model doesn't hold as they are: their words, which are the token itself if it is ASCII.
        others = {i: [tokens[i]] if tokens[i].isascii() and tokens[i] else _WORDS.findall(tokens[i]) for i in np.flatnonzero(at < 0).tolist()}
        letters[[i for i, words in others.items() if not words]] = False
        if langs:
            unseen = self._learn({w for words in others.values() for w in words if w not in self.model.words})
            for i, words in others.items():
                for word in words:
                    row = self.model.words.get(word)
                    logs[i] += unseen[word] if row is None else self.model.word_logs[row]
        has_letter = np.bincount(texts.doc, weights=letters[numbers], minlength=texts.n) > 0
        if not langs:
            return [UNKNOWN] * texts.n, np.zeros(texts.n)
        totals = np.stack([np.bincount(texts.doc, weights=logs[numbers, k], minlength=texts.n) for k in range(len(langs))], axis=1)
        best = totals.argmax(1)
        above = np.maximum(totals - totals[np.arange(texts.n), best][:, None], -700)
        scores = np.where(has_letter, 1 / np.exp(above).sum(1), 0.0)
        return [langs[b] if known else UNKNOWN for b, known in zip(best.tolist(), has_letter.tolist())], scores


_scorers: dict[str, Scorer] = {}


def scorer_of(model: Model) -> Scorer:
    """One scorer per worker, so that a task begins with the words of those before it."""
    if model.name not in _scorers:
        _scorers.clear()
        _scorers[model.name] = Scorer(model)
    return _scorers[model.name]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`(doc_id, held_out, lang_pred, score)` of every row of `docs`.

    Only the text counts, whole. Null texts and texts without letters are `und` with score 0, as all are if nothing
    could be learned; of equal languages the first by name wins. Rows are independent; a null doc_id folds as an empty
    text; other columns are ignored; no rows give no rows.
    """

    def batches(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model)
        for batch in blocks(given):
            found, scores = scorer.predict(batch["text"])
            columns = [batch["doc_id"], pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = on_workers(rows, batches, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold(MODULUS) == HELD).alias("held_out"), "lang_pred", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
