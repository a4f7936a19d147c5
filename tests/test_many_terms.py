"""Searches whose prefixes stand for very many terms: postings are found by stem, and go by document once whatever the phrases."""

import json

import pytest
from pyspark.sql import functions as F
from test_operators import SITE, doc, docs_of
from test_shuffled_bytes import log_of, plan_of

from inkwell.functions import text
from inkwell.functions.stems import porter
from inkwell.operators import indexing, matching
from inkwell.plans import search as searching
from inkwell.plans.index import build_index
from inkwell.session import scratch_path
from inkwell.streaming import feed

STRINGS = ("qu", "stone qu", '"old quarry"', "old-qu", "quarr-stones", "old-old", "title:quiet", "stones -qu")


@pytest.fixture(scope="module")
def quarries(spark):
    body = lambda i: f"old quarry{i} old old quarry stones quarry stone{'s' * (i % 2)} quiet{i} quoted running runs old quarries"
    rows = (doc(f"k{i:02d}", title="old quarry quiet runs" if i % 3 else "stone old", plaintext=body(i)) for i in range(30))
    return build_index(spark, docs_of(spark, *rows), scratch_path(spark, "quarries"), 2)


def slot_terms_of(spark, index):
    log, _ = searching.with_clause_numbers(searching.read_log(log_of(spark, *STRINGS)))
    return log, searching.clause_terms(index, log)


def rows_of(frame):
    return sorted(map(str, frame.collect()))


def test_rows_do_not_depend_on_how_many_terms_there_are(spark, quarries, monkeypatch):
    log, slot_terms = slot_terms_of(spark, quarries)
    columns = ("clause_key", "slot", "n_terms", "term", "id", "col", "n_places", "positions")
    found = lambda: rows_of(matching.term_lookup(slot_terms, quarries.postings, 2).select(*columns))
    clauses = lambda: rows_of(searching.clause_matches(quarries, log, slot_terms))
    phrases = lambda: rows_of(matching.phrase_candidates(slot_terms, quarries.postings, 2))
    few = found(), clauses(), phrases()
    monkeypatch.setattr(matching, "FEW", 3)
    assert not matching.is_few(slot_terms) and (found(), clauses(), phrases()) == few and all(few)


def test_postings_of_many_terms_stay_where_they_are(spark, quarries, monkeypatch):
    log, slot_terms = slot_terms_of(spark, quarries)
    monkeypatch.setattr(matching, "FEW", 40)
    assert not matching.is_few(slot_terms)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan_of(matching.term_lookup(slot_terms, quarries.postings, 2))
        candidates = searching.settle(matching.phrase_candidates(slot_terms, quarries.postings, 2), "candidates")
        phrases = matching.match_phrases(slot_terms, quarries.postings, candidates, 2)
        plan = plan_of(phrases)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in found
    # Positions are shuffled by document, without the clauses that seek them.
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len([x for x in moved if "REPARTITION_BY_COL" in x]) == 1 and not [x for x in moved if "term#" in x]
    assert phrases.count() > 0


def test_both_stemmers_agree(spark):
    starts = ("", "b", "yh", "ab", "trou", "y", "ño", "hop", "fil", "conflat", "ß1", "yy", "oo", "tr", "漢字")
    ends = ("", "s", "y", "e", "ll", "eed", "ed", "ing", "ies", "sses", "ss", *text.STEP2, *text.STEP3, *text.STEP4)
    words = {a + b + c for a in starts for b in ends for c in ("", "s", "ing", "al")} - {""} | {"x" * 70 + "ing", "ü" * 31 + "ing"}
    rows = spark.createDataFrame([(w,) for w in sorted(words)], "term string").select("term", text.stem("term").alias("stem")).collect()
    assert [(r.term, r.stem) for r in rows if porter(r.term) != r.stem] == [] and len(rows) > 3000


def test_marks_count_the_documents_of_a_stem(spark, quarries):
    """One posting is marked for every stem and document, one for every stem and title."""
    held = quarries.postings.groupBy("stem").agg(
        F.countDistinct("id").alias("n"), F.countDistinct(F.when(F.col("col") == "title", F.col("id"))).alias("t"),
        F.count_if("stem_lead").alias("leads"), F.count_if("title_lead").alias("titles"),
    )
    assert held.where("n != leads or t != titles").count() == 0 and held.where("t > 0").count() > 0
    stored = quarries.vocab.select("stem", "stem_docs", "stem_title_docs").distinct()
    assert stored.join(held, "stem").where("n = stem_docs and t = stem_title_docs").count() == stored.count() == held.count()
    assert quarries.vocab.where(F.col("stem") != text.stem("term")).count() == 0
    plan = plan_of(indexing.with_stem_counts(indexing.build_vocab(quarries.postings)))
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_postings_of_a_feed_stay_where_they_are(spark, tmp_path, monkeypatch):
    """Few rows lost: they meet the postings, however many won."""
    landing, out = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    for k, ids in enumerate((range(8), range(2))):
        items = [{"id": f"k{i}", "title": f"set {k}", "plaintext": "old stones", "updated_at": f"2024-0{k + 1}"} for i in ids]
        (landing / f"{k}.json").write_text(json.dumps({"posts": items}))
        feed.stream_archive(spark, str(landing), out, str(tmp_path / "marks"), "post", SITE).awaitTermination()
    monkeypatch.setattr(matching, "FEW", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = feed.current_postings(spark, out)
        plan = plan_of(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert {r.id: r.term for r in found.where("col = 'title' and term != 'set'").collect()} == {f"k{i}": "1" if i < 2 else "0" for i in range(8)}
