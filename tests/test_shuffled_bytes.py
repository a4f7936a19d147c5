"""What plans shuffle: narrow rows of matches, bodies but not their words, and no table for the sake of itself."""

import pytest
from pyspark.sql import functions as F
from test_operators import doc, docs_of

from inkwell.operators import indexing, matching
from inkwell.plans import search as searching
from inkwell.plans.index import build_index
from inkwell.session import scratch_path
from inkwell.sources import testtables


@pytest.fixture
def no_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def stones(spark):
    docs = docs_of(spark, *(doc(f"k{i}", title="stone", plaintext="old quarry stones " * (i + 1)) for i in range(5)))
    return build_index(spark, docs, scratch_path(spark, "stones"), 2)


def log_of(spark, *strings):
    return spark.createDataFrame([(i, s, True) for i, s in enumerate(strings)], "query_id long, raw string, prefix_last boolean")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_words_of_bodies_are_not_shuffled(spark, stones, no_broadcasts):
    hits = searching.search_batch(stones, log_of(spark, "quar", "stone old"))
    lines = plan_of(hits).splitlines()
    taken_apart = [i for i, line in enumerate(lines) if "_words" in line]
    assert taken_apart and not [line for line in lines[taken_apart[0] : taken_apart[-1]] if "Exchange" in line]
    assert hits.count() == 10


def test_postings_stay_where_they_are_for_few_terms(spark, stones, no_broadcasts):
    log, names = searching.with_clause_numbers(searching.read_log(log_of(spark, "stone", "quarry")))
    slot_terms = searching.clause_terms(stones, log)
    found = matching.term_lookup(slot_terms, stones.postings, stones.buckets)
    assert "SortMergeJoin" not in plan_of(found) and found.count() > 0
    matches = searching.clause_matches(stones, log, slot_terms, with_facts=False)
    assert matches.columns == ["id", "clause_key", "freq"]
    with_facts = searching.clause_matches(stones, log, slot_terms)
    assert with_facts.columns == ["id", "clause_key", *indexing.DOC_FACTS, "freq"] and with_facts.count() == matches.count()
    # Every clause has one number.
    assert dict(log.clauses.dtypes)["clause_key"] == "bigint"
    assert names.count() == names.select("number").distinct().count() == log.clauses.select("clause_key").distinct().count()


def test_landing_reads_its_tables_once(spark, sf_dir, no_broadcasts):
    posts, pages = testtables.raw_json_posts(spark, sf_dir), testtables.raw_json_pages(spark, sf_dir)
    assert plan_of(posts).count("SortMergeJoin") == 1 and "Join" not in plan_of(pages)
    assert posts.count() == testtables.posts(spark, sf_dir).count() and pages.count() == testtables.pages(spark, sf_dir).count()


def test_tokens_come_from_one_scan(spark, stones):
    tokens = indexing.tokenize(stones.documents)
    assert plan_of(tokens).count("FileScan") == 1
    assert tokens.where("id = 'k1'").groupBy("col").agg(F.count("*").alias("n")).where("n > 0").collect()
