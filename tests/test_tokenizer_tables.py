"""Tokens and stems against the vocabulary of SQLite's full-text search."""

import sqlite3
import unicodedata

from pyspark.sql import functions as F

from inkwell.functions.text import stem, terms
from inkwell.sources import testtables


def engine_terms(texts, tokenizer):
    db = sqlite3.connect(":memory:")
    db.execute(f"CREATE VIRTUAL TABLE x USING fts5(body, tokenize = '{tokenizer}')")
    db.executemany("INSERT INTO x(rowid, body) VALUES (?, ?)", enumerate(texts))
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(x, 'instance')")
    found = {}
    for term, doc, offset in db.execute("SELECT term, doc, offset FROM v ORDER BY doc, offset"):
        found.setdefault(doc, []).append(term)
    return [found.get(i, []) for i in range(len(texts))]


def our_terms(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "n long, t string")
    return [r["l"] for r in frame.select("n", terms(F.col("t")).alias("l")).orderBy("n").collect()]


def test_tokens_of_the_tables(spark, sf_dir):
    texts = [f'{r["title"]} {r["plaintext"]}' for r in testtables.archive(spark, sf_dir).select("title", "plaintext").collect()]
    assert our_terms(spark, texts) == engine_terms(texts, "unicode61")


def test_symbols(spark):
    """Every named symbol between two letters, emoji of all Unicode versions included."""
    codes = [c for c in (*range(0x2190, 0x2C00), *range(0x1F000, 0x1FB00)) if unicodedata.name(chr(c), "")]
    texts = [f"a{chr(c)}b" for c in codes]
    wrong = [hex(c) for c, ours, theirs in zip(codes, our_terms(spark, texts), engine_terms(texts, "unicode61")) if ours != theirs]
    assert wrong == []


def test_stems_of_the_tables(spark, sf_dir):
    texts = [f'{r["title"]} {r["plaintext"]}' for r in testtables.archive(spark, sf_dir).select("title", "plaintext").collect()]
    endings = ("", "s", "es", "ed", "ing", "ation", "ational", "izer", "fulness", "ement", "y", "ies", "ll", "eed")
    words = sorted({w for ws in engine_terms(texts, "unicode61") for w in ws} | {b + e for b in ("hop", "relat", "agre", "control", "fl", "yt") for e in endings})
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    ours = {r["w"]: r["s"] for r in frame.select("w", stem("w").alias("s")).collect()}
    theirs = dict(zip(words, (x[0] for x in engine_terms(words, "porter unicode61"))))
    assert {w: (ours[w], theirs[w]) for w in words if ours[w] != theirs[w]} == {}
