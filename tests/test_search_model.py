"""Hits, scores and snippets of whole logs against SQLite's full-text search."""

import random

import pytest
from reference_model import fts_archive, fts_search, parse

from inkwell.operators.searchlog import search_log_clauses
from inkwell.plans.index import build_index
from inkwell.plans.search import search_batch
from inkwell.session import scratch_path
from inkwell.sources import testtables

def hostile_strings():
    """Every sign of the search syntax at every place, every key with odd values, operator words as words."""
    out = []
    for sign in '"()*^{}\\:-+,.~':
        out += [sign, sign * 3, f"{sign}the", f"the{sign}", f"of {sign} the", f"of{sign}the", f"-{sign}"]
    for key in ("title", "tag", "status", "type", "before", "after", "other"):
        out += [f"{key}:", f"{key.upper()}:en", f"{key}:% the", f"-{key}:en", f"{key}:2024-13 the", f'{key}:"of', f"{key}:{key}:x"]
    for word in ("AND", "OR", "NOT", "NEAR"):
        out += [word, f"the {word} of", f"{word}(the of)", f"{word.lower()}/2 the"]
    return out + ["\t\n", "tag:src1 tag:src2", "after:2022 after:2024 the", "before:2024-06-05"]


def log_of(spark, rows):
    return spark.createDataFrame(rows, "query_id long, raw string, prefix_last boolean")


@pytest.fixture(scope="module")
def indexed(spark, sf_dir):
    docs = testtables.archive(spark, sf_dir)
    index = build_index(spark, docs, scratch_path(spark, "index"), buckets=4)
    return index, fts_archive(docs.collect())


def made_up_queries(words, n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 3)):
            w = rng.choice(words)
            parts.append(
                rng.choice([w, w, w, f"-{w}", f"title:{w}", f'"{w} {rng.choice(words)}"', w[:3], f"{w}.{rng.choice(words)}",
                            "tag:en", "after:2023", "before:2024-05", "status:sent", "type:post"])
            )
        out.append((i, " ".join(parts), rng.random() < 0.4))
    return out


def check(spark, indexed, rows):
    index, db = indexed
    got = {}
    for r in search_batch(index, log_of(spark, rows)).select("query_id", "rank", "id", "score", "snippet").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r
    for query_id, raw, prefix_last in rows:
        want = fts_search(db, raw, prefix_last)
        hits = [got.get(query_id, {}).get(k) for k in range(1, len(want) + 1)]
        assert len(got.get(query_id, {})) == len(want), raw
        # SQLite does not sum in a fixed order for phrases, so ties are compared on rounded scores.
        rounded = lambda rows: sorted((round(s, 9), i) for i, s, _ in rows)
        assert [round(h["score"], 9) for h in hits] == [round(w[1], 9) for w in want], raw
        assert rounded([(h["id"], h["score"], "") for h in hits]) == rounded(want) or len(want) == 50, raw
        snippets = {w[0]: w[2] for w in want}
        for h in hits:
            if h["id"] in snippets:
                assert h["snippet"] == snippets[h["id"]], (raw, h["id"])


def test_hostile_strings(spark, indexed):
    rows = [(i, q, i % 2 == 0) for i, q in enumerate(hostile_strings())]
    check(spark, indexed, rows)


def test_log_of_the_tables(spark, indexed, sf_dir):
    check(spark, indexed, [tuple(r) for r in testtables.search_log(spark, sf_dir).collect()])


def test_made_up_log(spark, indexed, sf_dir):
    bodies = [r["plaintext"] for r in testtables.archive(spark, sf_dir).select("plaintext").collect()]
    words = sorted({w for b in bodies for w in b.split()})
    words += ["the", "of", "and", "th", "le", "de", "ñ", "der"] * (len(words) // 20)
    check(spark, indexed, made_up_queries(words, 120, 7))


def test_phrases_of_the_texts(spark, indexed, sf_dir):
    """Phrases cut from real bodies, so that positions matter."""
    rng = random.Random(3)
    bodies = [r["plaintext"].split() for r in testtables.archive(spark, sf_dir).select("plaintext").collect()]
    bodies = [b for b in bodies if len(b) > 8]
    rows = []
    for i in range(60):
        b = rng.choice(bodies)
        k, at = rng.randint(2, 5), rng.randint(0, len(b) - 6)
        phrase = " ".join(b[at : at + k]).replace('"', "")
        tail = rng.choice(["", " the", f" {rng.choice(b)}", " -zzz"])
        rows.append((i, rng.choice(['"{}"{}', '{}{}', '"{}{}']).format(phrase, tail), rng.random() < 0.5))
    check(spark, indexed, rows)


def test_random_strings_parse_like_the_loop(spark):
    rng = random.Random(11)
    alphabet = ['"', " ", "-", ":", "a", "T", "\t", " ", "tag:", "title:", "before:", "2024", "-05", "status:", "Sent", "type:", "page"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9))), rng.random() < 0.5) for i in range(1500)]
    queries, clauses = search_log_clauses(log_of(spark, rows))
    filters = {r["query_id"]: r for r in queries.collect()}
    texts = {}
    for r in clauses.orderBy("query_id", "clause_no").collect():
        texts.setdefault(r["query_id"], []).append((r["negated"], r["title_only"], r["prefix"], r["text"]))
    for i, raw, prefix_last in rows:
        want_filters, want_clauses = parse(raw, prefix_last)
        got = {k: filters[i][k] for k in ("tag", "before", "after", "status", "type") if filters[i][k] is not None}
        assert got == want_filters, raw
        assert texts.get(i, []) == want_clauses, raw
        assert filters[i]["n_positive"] == sum(not c[0] for c in want_clauses), raw
