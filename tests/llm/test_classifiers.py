"""Classifiers: held-out accuracy, the mathematics against enumeration, hard rows."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from inkwell.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.01"


def held(doc_id, modulus, remainder):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == remainder


def tables(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_marginals_by_enumeration():
    draw = np.random.default_rng(1)
    odds, change = draw.normal(size=(3, 5)), draw.normal(size=(2, 2))
    marginals, pairs = quality.forward_backward(odds, change)
    want, want_pairs = np.zeros((3, 5)), np.zeros((2, 2))
    for c in range(3):
        paths = list(itertools.product((0, 1), repeat=5))
        mass = np.exp([sum(odds[c, t] * p[t] for t in range(5)) + sum(change[a, b] for a, b in itertools.pairwise(p)) for p in paths])
        mass /= mass.sum()
        for p, m in zip(paths, mass):
            want[c] += np.array(p) * m
            for a, b in itertools.pairwise(p):
                want_pairs[a, b] += m
    assert np.allclose(marginals, want) and np.allclose(pairs, want_pairs)


def test_neighbours_enter_the_features():
    values, lengths = quality.chain_features("One line here.\n\nSHOUT!! SHOUT!!\nOne line here.")
    assert values.shape == (3, 3 * quality.OWN + 2) and lengths.tolist() == [14, 15, 14]
    assert np.array_equal(values[0, 2 * quality.OWN : 3 * quality.OWN], values[1, : quality.OWN])
    assert np.array_equal(values[2, quality.OWN : 2 * quality.OWN], values[1, : quality.OWN])
    assert not values[0, quality.OWN : 2 * quality.OWN].any()


def accuracy(frame, labels, column, modulus, remainder):
    truth = {r.doc_id: r[column] for r in labels.collect()}
    rows = [r for r in frame.collect() if r.doc_id in truth]
    assert all(r.held_out == held(r.doc_id, modulus, remainder) and 0 <= r.score <= 1 for r in rows)
    return Counter((truth[r.doc_id], r.predicted) for r in rows if r.held_out)


def test_quality(spark):
    found = accuracy(quality.op3_quality_classifier(spark, SF), tables(spark, "labels"), "quality", 5, 0)
    assert (found[0, 0] + found[1, 1]) / sum(found.values()) > 0.95


def test_toxicity(spark):
    """Few rows to learn from: no clean text is called toxic, and most words known by then are caught."""
    found = accuracy(toxicity.op8_toxicity(spark, SF), tables(spark, "labels"), "toxic", 3, 1)
    assert found[1, 1] / (found[1, 0] + found[1, 1]) > 0.4 and found[0, 1] / (found[0, 0] + found[0, 1]) < 0.03


def test_ftrl_is_sparse_and_finds_the_word():
    draw = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for n in range(400):
        text = " ".join(draw.choice(words, 40))
        rows.append((text + " vile" if n % 8 == 0 else text, int(n % 8 == 0)))
    model = toxicity.fit(rows)
    assert len(model.places) < 400
    low, high = model.scores(["w1 w2 w3", "w1 w2 vile w3"])
    assert low < 0.3 and high > 0.7


@pytest.mark.parametrize("module", [quality, toxicity])
def test_no_rows_and_hard_rows(spark, nasty, nothing, module):
    model = module.fit([])
    got = module.score(nasty, model).collect()
    assert len(got) == nasty.count() and all(r.score == 0.5 for r in got)
    model = module.fit([("Good words stand here. And more.", 1), ("!!! ### !!!", 0), ("", 0), (" \n ", 1)] * 5)
    got = module.score(nasty, model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in got)
    assert all(r.held_out == held(r.doc_id, module.MODULUS, module.HELD) for r in got)
    assert module.score(nothing, model).collect() == []


def test_training_ignores_held_out_and_repeated_labels(spark, nasty):
    from inkwell.llm.common import labelled_sample

    labels = spark.createDataFrame([(i, 1, None) for i in (2, 4, 5, 5, 6, 7, 8, 9)] + [(None, 1, 0), (10, None, 1)], "doc_id long, quality int, toxic int")
    rows = labelled_sample(nasty, labels, "quality", 5, 0, 100)
    assert len(rows) == sum(not held(i, 5, 0) for i in (2, 4, 5, 6, 7, 8, 9)) and {y for _, y in rows} == {1}
    assert len(labelled_sample(nasty, labels, "quality", 5, 0, 3)) == 3
    assert len(labelled_sample(nasty, labels, "toxic", 5, 0, 100)) == int(not held(10, 5, 0))
    texts = sorted(t for t, _ in rows)
    assert max(map(len, texts)) < 200 < sum(map(len, texts))
    fitting = [t for t, _ in labelled_sample(nasty, labels, "quality", 5, 0, 100, 200)]
    left = list(texts)
    for t in fitting:
        left.remove(t)  # whole texts only
    room = 200 - sum(len(t.encode()) for t in fitting)
    assert room >= 0 and left and all(len(t.encode()) > room for t in left)
    assert labelled_sample(nasty, labels, "quality", 5, 0, 100, 0) == [(t, 1) for t in texts if not t]


def test_long_words_are_not_kept():
    from inkwell.llm import decontamination

    known = decontamination.Codes()
    words = [b"short", b"x" * 10_000, b"y" * decontamination.KEPT_BYTES]
    assert [known[w] for w in words] == [known[w] for w in words] == [decontamination._code(w) for w in words]
    assert set(known) == {words[0], words[2]}
    toxicity.features("short " + "z" * 10_000)
    assert max(map(len, toxicity._known)) <= toxicity.KEPT_CHARS


def test_a_worker_keeps_one_operators_tables():
    from inkwell.llm import common

    made = []
    for key in ("a", "a", "b", "a"):
        assert common.held(key, lambda key=key: made.append(key) or key) == key
    assert made == ["a", "b", "a"]
    common.release()
    assert common._held == {}


def test_language(spark):
    truth = {r.doc_id: r.lang for r in tables(spark, "documents").collect()}
    rows = langid.op4_language_id(spark, SF).collect()
    assert len(rows) == len(truth) and all(r.held_out == held(r.doc_id, 5, 0) for r in rows)
    right = [truth[r.doc_id] == r.lang_pred for r in rows if r.held_out]
    assert sum(right) / len(right) > 0.97


def test_language_word_counts(spark, nasty):
    want = Counter()
    for r in nasty.select("doc_id", "text", "lang").collect():
        if r.lang is not None and not held(r.doc_id, 5, 0):
            want.update((w, r.lang) for w in langid._WORDS.findall((r.text or "").lower()) if w.isascii())
    got = {(r.word, r.lang): r.n for r in langid.word_counts(nasty).collect() if r.word.isascii()}
    assert got == want


def predicted(scorer, text):
    (lang,), (score,) = scorer.predict(pa.array([text], pa.string()))
    return lang, score


def plain_language(model, text):
    """Word by word: known words by their frequency, others by the mean of their longest known n-grams."""
    total, words = [0.0] * len(model.langs), regex.findall(r"\p{L}+", text.lower())
    for word in words:
        if word in model.words:
            logs = model.word_logs[model.words[word]].tolist()
        else:
            logs = [0.0] * len(model.langs)
            for order in langid.ORDERS:
                cut = [f"^{word}$"[i : i + order] for i in range(len(word) + 3 - order)]
                rows = [model.gram_logs[model.grams[g]].tolist() for g in cut if g in model.grams]
                if rows:
                    logs = [sum(x) / len(rows) for x in zip(*rows)]
                    break
        total = [a + b for a, b in zip(total, logs)]
    if not words or not model.langs:
        return "und", 0.0
    best = max(range(len(total)), key=lambda i: total[i])
    return model.langs[best], 1 / sum(math.exp(max(x - total[best], -700)) for x in total)


def test_language_against_a_plain_loop(spark, nasty):
    docs = tables(spark, "documents")
    for size in (300, 60_000):
        model = langid.train(docs, words=size, grams=size)
        scorer = langid.Scorer(model)
        texts = [r.text or "" for r in docs.limit(150).collect()] + [r.text or "" for r in nasty.select("text").collect()] + ["m²", "x₂y", "²", "Ünder-Été", "İK"]
        langs, scores = scorer.predict(pa.array(texts))
        for text, lang, score in zip(texts, langs, scores):
            want = plain_language(model, text)
            assert lang == want[0] and score == pytest.approx(want[1], abs=1e-3), text


def test_language_backoff(spark, nasty, nothing):
    rows = [(i, "the house of the water and the stone", "en", "s", 1) for i in range(9)]
    rows += [(i, "das wasser und der stein und das haus", "de", "s", 1) for i in range(20, 29)]
    model = langid.train(spark.createDataFrame(rows, nasty.sparkSession.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").schema))
    scorer = langid.Scorer(model)
    assert predicted(scorer, "the water")[0] == "en" and predicted(scorer, "wasserstein")[0] == "de"  # unseen word
    assert predicted(scorer, "")[0] == predicted(scorer, "12 !? ²")[0] == "und" and predicted(scorer, "m²")[0] != "und"
    assert predicted(scorer, "漢字漢字")[1] == pytest.approx(0.5, abs=0.05)  # nothing known of it
    got = langid.identify(nasty, model).collect()
    assert len(got) == nasty.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    empty = langid.train(nothing)
    assert {r.lang_pred for r in langid.identify(nasty, empty).collect()} == {"und"}
    assert langid.identify(nothing, model).collect() == []


def test_language_ngrams_of_all_words(spark):
    """N-grams are those of all training words, however few words the model holds, and of words of any length."""
    long = "".join(chr(97 + i * i % 26) + chr(97 + i % 23) for i in range(150))
    rows = [(i, f"stone river {long} \u00fcber", "en") for i in range(9)] + [(i, "wasser haus", "de") for i in range(20, 29)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), words=1)
    want = {f"^{w}$"[i : i + o] for w in ("stone", "river", long, "\u00fcber", "wasser", "haus") for o in langid.ORDERS for i in range(len(w) + 2)}
    assert len(model.words) == 1 and set(model.grams) == want
    scorer = langid.Scorer(model)
    assert predicted(scorer, "rivers")[0] == "en" and predicted(scorer, "hausw")[0] == "de"
