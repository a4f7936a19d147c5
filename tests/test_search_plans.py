"""How searches read the index: what is read, shuffled and counted follows the rare words, the hits and the changes."""

import json
import time

import pytest
from pyspark.sql import functions as F
from test_operators import SITE, doc, docs_of

from inkwell.operators import conjunction
from inkwell.operators.snippets import clause_instances, clause_slot_lists, snippets, text_columns
from inkwell.plans import search as searching
from inkwell.plans.index import build_index
from inkwell.session import scratch_path
from inkwell.streaming import feed


@pytest.fixture(scope="module")
def wide_index(spark):
    """Documents that all hold two common words, with very many rare ones, in two buckets."""
    rows = spark.range(4000).withColumnRenamed("id", "n").select(
        F.concat(F.lit("k"), F.lpad(F.col("n").cast("string"), 5, "0")).alias("id"),
        F.concat(F.lit("common shared running "), F.when(F.col("n") % 2 == 0, "runs ").otherwise(""),
                 F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("zq"), (F.col("n") * 10 + i).cast("string"))), " "),
                 F.when(F.col("n") == 77, " quartz").otherwise("")).alias("plaintext"),
    )
    blank = docs_of(spark, doc("x", title="title word")).drop("id", "plaintext")
    docs = rows.join(blank).select(*docs_of(spark).columns)
    return build_index(spark, docs, scratch_path(spark, "wide"), 2)


def rows_read(frame):
    """Rows that come out of the scans of a plan without shuffles."""
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_rare_word_reads_few_pages(spark, wide_index):
    total = wide_index.postings.count()
    bucket = wide_index.postings.where("term = 'quartz'").select("term_bucket").first()[0]
    found = searching._among(wide_index.postings, "term_bucket", "term", [(bucket, "quartz")])
    assert found.count() == 1 and rows_read(found) <= total / 8
    ids = wide_index.documents.where("id = 'k00077'").select("id_bucket").first()[0]
    one = searching._among(wide_index.documents, "id_bucket", "id", [(ids, "k00077")])
    assert rows_read(one) <= 2000 and [r.id for r in one.collect()] == ["k00077"]
    assert searching._among(wide_index.documents, "id_bucket", "id", []).count() == 0


def test_stem_counts_are_those_of_the_postings(spark, wide_index):
    """Counts of a stem with several terms are of its documents, not of its terms."""
    terms = {r.term: r for r in wide_index.vocab.where("term in ('running', 'runs', 'quartz', 'title')").collect()}
    assert terms["running"].stem == terms["runs"].stem
    assert terms["running"].n_docs == 4000 and terms["runs"].n_docs == 2000
    assert terms["running"].stem_docs == terms["runs"].stem_docs == 4000 and terms["runs"].stem_title_docs == 0
    assert terms["quartz"].stem_docs == 1 and terms["title"].stem_title_docs == terms["title"].stem_docs == 4000


def parsed(spark, *strings):
    log = spark.createDataFrame([(i, s, False) for i, s in enumerate(strings)], "query_id long, raw string, prefix_last boolean")
    return searching.read_log(log)


def test_queries_follow_their_rarest_clause(spark, wide_index):
    log = parsed(spark, "common quartz", "common -quartz", "shared quartz title:word -zq5", "common nowhere", "runs")
    slot_terms = searching.clause_terms(wide_index, log)
    clauses = conjunction.ranked_clauses(log.clauses, conjunction.clause_counts(slot_terms, None))
    named = clauses.join(log.clauses.select("query_id", "clause_no", "text"), ["query_id", "clause_no"])
    leading = {r.query_id: r.text for r in named.where("leads").collect()}
    assert leading == {0: "quartz", 1: "common", 2: "quartz", 4: "runs"}  # nothing holds all of the fourth
    first = named.where("query_id in (0, 2)")
    queries = log.queries.select("query_id", F.struct("status", "type", "after", "before", "tag").alias("q"))
    found = conjunction.candidates(slot_terms, wide_index.postings, 2, None, first.where("leads").join(queries, "query_id"))
    others = first.where("not leads")
    pairs = conjunction.wanted_pairs(found, others)
    assert found.count() == 2 and pairs.count() == others.count()
    # Postings of "common" and "shared" go on for the one document with the rare word alone.
    assert conjunction.other_rows(slot_terms, wide_index.postings, 2, None, pairs, others).count() == 3
    held = searching.held_documents(wide_index, log, slot_terms)
    assert {(r.query_id, r.n) for r in held.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {(0, 1), (1, 3999), (2, 1), (4, 4000)}


def test_snippets_are_linear_in_the_places(spark):
    body = "alpha beta. " * 50_000
    hits = spark.createDataFrame([(1, body)], "query_id long, plaintext string")
    wanted = spark.createDataFrame(
        [(1, 0, 1, 0, "alpha"), (1, 1, 2, 0, "beta"), (1, 1, 2, 1, "alpha")], "query_id long, clause_no int, n_terms int, slot int, term string"
    )
    start = time.time()
    placed = clause_instances(text_columns(hits).join(clause_slot_lists(wanted), "query_id"))
    (row,) = snippets(placed).select("snippet", F.size("instances").alias("n")).collect()
    assert row.n == 99_999 and row.snippet.startswith("[alpha] [beta. alpha] ") and time.time() - start < 30


def test_counts_after_a_feed_are_those_of_the_documents(spark, tmp_path):
    """The maintained counts equal those of an index built from the current documents."""
    base = docs_of(spark, *(doc(f"k{i}", title=f"stone {i}", plaintext="running water " + "runs " * (i % 2), updated_at="2024-01") for i in range(12)))
    index = build_index(spark, base, scratch_path(spark, "held"), 2)
    landing, out = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    items = [{"id": f"k{i}", "title": "moss", "plaintext": "run stones", "updated_at": "2024-02"} for i in range(5)]
    items += [{"id": "n1", "title": "new water", "plaintext": "waters quartz", "updated_at": "2024-02"}, {"id": "k7", "title": "old", "updated_at": "2023"}]
    (landing / "1.json").write_text(json.dumps({"posts": items}))
    feed.stream_archive(spark, str(landing), out, str(tmp_path / "marks"), "post", SITE).awaitTermination()
    live = feed.live_index(spark, index, out)
    built = build_index(spark, feed.current_documents(spark, out, base), scratch_path(spark, "built"), 2)
    assert (live.n_docs, live.all_tokens) == (built.n_docs, built.all_tokens) and live.avg_len == built.avg_len
    columns = ("term", "stem", "n_docs", "n_title", "stem_docs", "stem_title_docs")
    counts = lambda vocab: sorted(map(tuple, vocab.where("n_docs > 0").select(*columns).collect()))
    assert counts(live.vocab) == counts(built.vocab) != counts(index.vocab)


def test_a_feed_forgets_what_is_pruned_and_takes_it_back_later(spark, tmp_path):
    base = docs_of(spark, *(doc(f"k{i}", title=f"stone {i}", plaintext="running water", updated_at="2024-01") for i in range(6)))
    index = build_index(spark, base, scratch_path(spark, "held"), 2)
    landing, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    landing.mkdir()

    def land(name, *items):
        (landing / name).write_text(json.dumps({"posts": [{"title": "moss", "plaintext": "run stones", **i} for i in items]}))
        feed.stream_archive(spark, str(landing), out, marks, "post", SITE).awaitTermination()

    def held():
        return {r["id"]: r["title"] for r in feed.current_documents(spark, out, base).collect()}

    def check(want):
        assert held() == want
        live = feed.live_index(spark, index, out)
        built = build_index(spark, feed.current_documents(spark, out, base), scratch_path(spark, "built"), 2)
        assert (live.n_docs, live.all_tokens) == (built.n_docs, built.all_tokens)
        columns = ("term", "stem", "n_docs", "n_title", "stem_docs", "stem_title_docs")
        counts = lambda vocab: sorted(map(tuple, vocab.where("n_docs > 0").select(*columns).collect()))
        assert counts(live.vocab) == counts(built.vocab)
        assert sorted(r["id"] for r in live.documents.collect()) == sorted(want)
        return live

    ids_of = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    # Without a segment yet: only the base can lose documents.
    assert feed.prune_feed(spark, out, ids_of("k0", "k1", "k2", "k3", "k4"), base) == 1
    land("1.json", {"id": "k0", "updated_at": "2024-02"}, {"id": "n", "updated_at": "2024-02"})
    assert held() == {"k0": "moss", "n": "moss"} | {f"k{i}": f"stone {i}" for i in range(1, 5)}
    segments = sorted(p.name for p in tmp_path.glob("out/changes/**/*.parquet"))
    assert feed.prune_feed(spark, out, ids_of("k1", "k2", "n"), base) == 3
    assert feed.prune_feed(spark, out, ids_of("k1", "k2", "n"), base) == 0
    assert segments == sorted(p.name for p in tmp_path.glob("out/changes/**/*.parquet"))
    check({"k1": "stone 1", "k2": "stone 2", "n": "moss"})
    # Back in a later segment, though older than the row that the base held.
    land("2.json", {"id": "k0", "updated_at": "2023"}, {"id": "k5", "updated_at": "2024-03"})
    live = check({"k0": "moss", "k1": "stone 1", "k2": "stone 2", "k5": "moss", "n": "moss"})
    folded = feed.compact(spark, index, out, scratch_path(spark, "folded"))
    assert sorted(r["id"] for r in folded.documents.collect()) == sorted(r["id"] for r in live.documents.collect())
    assert folded.n_docs == live.n_docs == 5
