"""How the index is built: without a shuffle of postings, with quick patterns and grouped tokens that change no result."""

from pyspark.sql import functions as F
from test_operators import doc, docs_of

from inkwell.functions import text
from inkwell.operators import indexing
from inkwell.plans.index import build_index, update_index
from inkwell.session import scratch_path


def test_postings_are_written_without_a_shuffle(spark, monkeypatch):
    docs = docs_of(spark, *(doc(f"k{i}", title="stone", plaintext="old quarry " * i) for i in range(5)))
    frame, plans = type(docs), []
    sort = frame.sortWithinPartitions

    def noted(self, *by):
        plans.append((self.columns, self._jdf.queryExecution().optimizedPlan().toString()))
        return sort(self, *by)

    monkeypatch.setattr(frame, "sortWithinPartitions", noted)
    index = build_index(spark, docs, scratch_path(spark, "i"), 2)
    of_postings = [plan for columns, plan in plans if "positions" in columns]
    assert of_postings and not [p for p in of_postings if "Repartition" in p or "Rebalance" in p]
    # Documents go to ranges of ids, not to one task a bucket.
    assert [p for columns, p in plans if "plaintext" in columns and "RepartitionByExpression [id_bucket" in p]
    assert index.postings.count() == 13 and index.documents.count() == 5


def test_quick_patterns_match_the_same(spark):
    code = "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"
    chars = spark.range(1, 0x110000).where("id < 55296 or id > 57343").select(F.expr(code).alias("c"))
    for plain, quick in ((text.TERM_PATTERN, text.QUICK_TERM), (text.WORD_PATTERN, text.QUICK_WORD)):
        both = chars.select(*(F.concat(F.lit(a), "c").rlike(f"^{p}$").alias(n) for a in ("", "a") for n, p in ((f"{a}plain", plain), (f"{a}quick", quick))))
        assert both.where("plain != quick or aplain != aquick").count() == 0 and both.where("plain").count() > 100_000


def test_grouping_does_not_depend_on_the_batch(spark, monkeypatch):
    """Blocks of a few tokens give the same postings, in the stored order; empty and missing texts have none."""
    texts = ["", "a b a", "Été b_c B", "straße ١٢ a", "x " * 50, "b"]
    rows = [doc(f"k{i % 5}", title=t[:3], plaintext=t) for i, t in enumerate(texts)]
    docs = docs_of(spark, *rows).withColumn("title", F.expr("nullif(title, 'b')")).coalesce(1)
    whole = [tuple(r) for r in indexing.build_postings(docs, 3).collect()]
    place = [r[0] for r in docs.limit(1).select(F.transform(F.array(*(F.lit(r[0]) for r in whole)), lambda t: indexing.bucket_of(t, 3))).collect()][0]
    assert [(b, r[0], r[1]) for b, r in zip(place, whole)] == sorted((b, r[0], r[1]) for b, r in zip(place, whole))
    monkeypatch.setattr(indexing, "BATCH_TOKENS", 2)
    assert sorted(map(str, whole)) == sorted(str(tuple(r)) for r in indexing.build_postings(docs, 3).collect())
    tokens = indexing.tokenize(docs).groupBy("id", "col", "term").agg(F.count("*").alias("n"))
    assert {(r.id, r.col, r.term): r.n for r in tokens.collect()} == {
        (r.id, r.col, r.term): r.n for r in indexing.build_postings(docs).groupBy("id", "col", "term").agg(F.sum("n_places").alias("n")).collect()
    }


def test_postings_meet_the_shorter_list_of_ids(spark, monkeypatch):
    """Where most documents changed, the ids that stay meet the postings, not those that go."""
    held = docs_of(spark, *(doc(f"k{i}", title="stone", plaintext="old quarry") for i in range(6)))
    index = build_index(spark, held, scratch_path(spark, "i"), 2)
    change = lambda *ids: docs_of(spark, *(doc(i, title="moss", plaintext="new") for i in ids))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    frame, plans = type(held), []
    sort = frame.sortWithinPartitions

    def noted(self, *by):
        if "positions" in self.columns:
            plans.append(self._jdf.queryExecution().executedPlan().toString())
        return sort(self, *by)

    monkeypatch.setattr(frame, "sortWithinPartitions", noted)
    try:
        most = update_index(spark, index, change("k0", "k1", "k2", "k3", "n"), scratch_path(spark, "i"))
        few = update_index(spark, index, change("k0"), scratch_path(spark, "i"), spark.createDataFrame([("k1",)], "id string"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftSemi" in plans[0] and "LeftAnti" in plans[1] and not [p for p in plans if "SortMergeJoin" in p]
    titles = lambda i: {r.id: r.term for r in i.postings.where("col = 'title'").collect()}
    assert titles(most) == {"k0": "moss", "k1": "moss", "k2": "moss", "k3": "moss", "n": "moss", "k4": "stone", "k5": "stone"}
    assert titles(few) == {"k0": "moss", "k2": "stone", "k3": "stone", "k4": "stone", "k5": "stone"}


def test_words_without_a_ruled_ending_are_their_own_stems(spark):
    """They don't go through the rules, and every ending that a rule looks for is told by its last letter."""
    endings = {"s", "y", "e", "ll", "eed", "ed", "ing", *text.STEP2, *text.STEP3, *text.STEP4}
    words = [f"yhop{end}" for end in (*endings, *"abfhjkopqvwxz059", "ñ", "ß", "漢")]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.col("w").rlike(text.RULED_END).alias("ruled"), text.stem("w").alias("s"))
    assert {r.w[4:] for r in rows.where("ruled").collect()} == endings
    assert rows.where("not ruled and s != w").count() == 0
