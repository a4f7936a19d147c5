"""Operators on small hand-made rows."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions import fields
from inkwell.operators import cleaning, filters, indexing, merging, ranking, reports
from inkwell.operators.highlighting import highlight, highlight_words
from inkwell.plans import sync
from inkwell.plans.index import build_index, update_index
from inkwell.plans.search import search, search_batch
from inkwell.session import scratch_path
from inkwell.sources import api_pages, archive, testtables
from inkwell.streaming import feed

SITE = "https://site.test"
DOC_SCHEMA = T.StructType(
    [T.StructField(n, T.ArrayType(T.StringType()) if n == "tags" else T.StringType()) for n in fields.DOCUMENT_COLUMNS]
)


def doc(id="a", type="post", status="published", title="Garden notes", url="u", plaintext="about plants", tags=(),
        published_at="2024-01-01T00:00:00.000Z", updated_at="2024-01-01T00:00:00.000Z"):
    return (id, type, status, title, id, url, f"{SITE}/e/{id}", plaintext, list(tags), published_at, updated_at)


def docs_of(spark, *rows):
    return spark.createDataFrame(list(rows), DOC_SCHEMA)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def bodies(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def records(spark, items, doc_type="post", **pagination):
    body = {f"{doc_type}s": items}
    if pagination:
        body["meta"] = {"pagination": pagination}
    return api_pages.parse_pages(bodies(spark, json.dumps(body)), doc_type)


# --- landed pages and cleaning ----------------------------------------------------------------
def test_cleaning_takes_defaults_for_missing_and_wrong_types(spark):
    raw = records(spark, [
        {"id": "1"},
        {"id": "2", "title": "", "status": "strange", "slug": 7, "url": False, "plaintext": 3.5, "tags": "no", "published_at": 1, "updated_at": []},
        {"id": "3", "title": "  ", "status": "sent", "url": "x", "tags": [{"slug": "one"}, {"name": "n"}, {"slug": ""}, 5, {"slug": 9}, {"slug": "two"}]},
    ])
    rows = {r["id"]: r for r in cleaning.normalize_documents(api_pages.page_documents(raw), SITE + "///").collect()}
    for key in ("1", "2"):
        r = rows[key]
        assert (r["status"], r["title"], r["slug"], r["plaintext"], r["updated_at"]) == ("draft", "(untitled)", "", "", "")
        assert r["url"] is None and r["published_at"] is None and r["tags"] == []
    assert rows["3"]["title"] == "  " and rows["3"]["tags"] == ["one", "two"] and rows["3"]["status"] == "sent"
    assert rows["1"]["editor_url"] == SITE + fields.EDITOR_PATH + "post/1"


@pytest.mark.parametrize("bad", [{"title": "no id"}, {"id": 5}, "text", None, [1]])
def test_a_record_without_id_fails_the_batch(spark, bad):
    raw = api_pages.page_documents(records(spark, [{"id": "1"}, bad]))
    with pytest.raises(Exception, match="no id"):
        cleaning.normalize_documents(raw, SITE).count()
    accepted, rejects = cleaning.split_rejects(raw, SITE)
    assert ids(accepted) == ["1"] and rejects.count() == 1


def test_unreadable_pages_fail_and_absent_collections_are_empty(spark):
    for bad in ("<html>", "7", "null", '"x"', '{"posts": ['):
        with pytest.raises(Exception):
            api_pages.parse_pages(bodies(spark, bad), "post").collect()
    fine = api_pages.parse_pages(bodies(spark, "{}", "[]", '{"posts": {"id": 1}}', '{"pages": [{"id": "x"}]}'), "post")
    assert api_pages.page_documents(fine).count() == 0 and fine.count() == 4


def test_page_coverage(spark):
    one = records(spark, [{"id": "1"}, {"id": "2"}], page=1, pages=3, total=5)
    three = records(spark, [{"id": "5"}], page=3, pages=3, total=5)
    other = records(spark, [{"id": "p"}], "page")
    pages = one.unionByName(three).unionByName(other)
    rows = {r["type"]: r for r in api_pages.page_coverage(pages).collect()}
    assert (rows["post"]["pages"], rows["post"]["total"], rows["post"]["n_docs"], rows["post"]["n_missing"]) == (3, 5, 3, 1)
    assert (rows["page"]["pages"], rows["page"]["total"], rows["page"]["n_missing"]) == (1, 1, 0)
    assert [(r["type"], r["page"]) for r in api_pages.missing_pages(pages).collect()] == [("post", 2)]


# --- links and forms --------------------------------------------------------------------------
def test_links(spark):
    rows = docs_of(
        spark, doc("a"), doc("b", status="sent", url=None), doc("c", status="draft", url="u"), doc("d", status="scheduled", title="[x] y"),
    )
    got = {r["id"]: r for r in fields.document_links(rows).collect()}
    assert [got[i]["link"] for i in "abcd"] == ["u", f"{SITE}/e/b", f"{SITE}/e/c", f"{SITE}/e/d"]
    assert got["d"]["markdown"] == rf"[\[x\] y]({SITE}/e/d)"
    assert [got[i]["is_draft"] for i in "abcd"] == [False, False, True, True]


def hits_frame(spark, *rows):
    full = [(1, k, *r[:-2], r[-2], r[-1]) for k, r in enumerate(rows, 1)]
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.LongType()), *DOC_SCHEMA.fields,
                           T.StructField("snippet", T.StringType()), T.StructField("score", T.DoubleType())])
    return spark.createDataFrame(full, schema)


def test_output_forms(spark):
    hits = hits_frame(
        spark,
        (*doc("a", tags=("x", "y")), "one\n  two ", -1.5),
        (*doc("b", status="draft", url=None, plaintext="  ", published_at=None, updated_at="2023-05-06T00"), "", -1.0),
    )
    log = spark.createDataFrame([(1,), (2,)], "query_id long")
    texts = [r["text"] for r in reports.hits_to_text(hits).orderBy("rank").collect()]
    assert texts == [
        " 1. Garden notes  2024-01-01\n    u\n    one two",
        f" 2. Garden notes [draft]  2023-05-06\n    {SITE}/e/b",
    ]
    lists = {r["query_id"]: r["text"] for r in reports.result_lists(log, hits).collect()}
    assert lists == {1: "\n\n".join(texts), 2: reports.NO_MATCHES}
    arrays = {r["query_id"]: json.loads(r["json"]) for r in reports.hits_to_json_array(log, hits).collect()}
    assert arrays[2] == [] and len(arrays[1]) == 2
    assert list(arrays[1][0]) == ["id", "type", "status", "title", "slug", "link", "url", "editorUrl", "tags", "publishedAt", "updatedAt", "snippet", "score"]
    assert arrays[1][1]["url"] is None and arrays[1][1]["link"] == f"{SITE}/e/b" and arrays[1][0]["tags"] == ["x", "y"]
    cards = [r["card"] for r in reports.article_cards(hits).orderBy("rank").collect()]
    assert cards[0] == "Garden notes\n2024-01-01  ·  post  ·  x, y\nu\n\nabout plants"
    assert cards[1].endswith("post  ·  draft\n" + f"{SITE}/e/b\n\n{reports.NO_BODY}")
    counts = {r["query_id"]: r["n_hits"] for r in reports.hit_counts(log, hits).collect()}
    assert counts == {1: 2, 2: 0}


def test_highlight(spark):
    words = lambda raw: spark.range(1).select(highlight_words(F.lit(raw)).alias("w")).first()["w"]
    assert words('vision -pro "one year" tag:x TITLE:y a "b') == ["vision", "pro", "one", "year"]
    log = spark.createDataFrame([(1, "a.c -pro"), (2, "tag:x")], "query_id long, raw string")
    hits = spark.createDataFrame([(1, "A.C abc Prose"), (2, "same")], "query_id long, plaintext string")
    got = {r["query_id"]: r["highlighted"] for r in highlight(hits, log, "$<", ">\\").collect()}
    assert got == {1: "$<A.C>\\ abc $<Pro>\\se", 2: "same"}


def test_ages_and_sizes(spark):
    now = "2024-03-10T12:00:00.000Z"
    cases = {
        "2024-03-10T11:59:30.000Z": "just now", "2024-03-10T11:59:00.000Z": "1 minute ago", "2024-03-10T11:01:00.000Z": "59 minutes ago",
        "2024-03-10T10:59:00.000Z": "1 hour ago", "2024-03-09T12:30:00.000Z": "23 hours ago", "2024-03-08T12:30:00.000Z": "1 day ago",
        "2024-03-01T12:00:00.000Z": "9 days ago",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", reports.age_text(F.col("t"), F.lit(now)).alias("age"))
    assert {r["t"]: r["age"] for r in df.collect()} == cases
    sizes = {10: "10 B", 2048: "2 KB", 5 * 1024 * 1024: "5.0 MB"}
    df = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", reports.size_text(F.col("n")).alias("s"))
    assert {r["n"]: r["s"] for r in df.collect()} == sizes
    nothing = spark.createDataFrame([], "key string, value string")
    assert reports.status_report(docs_of(spark, doc()), nothing, now).first()["age"] == "never"


def test_health(spark):
    rows = [doc(str(i), plaintext="" if i else "x") for i in range(10)]
    assert reports.archive_health(docs_of(spark, *rows)).first().asDict() == {"n_docs": 10, "n_empty": 9, "alarm": True}
    assert not reports.archive_health(docs_of(spark, *rows[:9])).first()["alarm"]
    assert reports.archive_health(docs_of(spark)).first().asDict() == {"n_docs": 0, "n_empty": 0, "alarm": False}
    counts = {r["type"]: r["n_docs"] for r in reports.type_counts(docs_of(spark, doc())).collect()}
    assert counts == {"post": 1, "page": 0}


# --- filters ----------------------------------------------------------------------------------
def test_filters(spark):
    rows = docs_of(
        spark, doc("1", tags=("apple", "b")), doc("2", tags=("apple-tv",)), doc("3", tags=("a\\b",), published_at=None),
        doc("4", type="page", published_at="2022-05-01T00:00:00.000Z"), doc("5", status="draft", tags=("x", "apple")),
    )
    pick = lambda **kw: ids(filters.filter_documents(rows, **kw))
    assert pick(tag="apple") == ["1", "5"] and pick(tag="APPLE-TV") == ["2"] and pick(tag="apple%") == ["1", "2", "5"]
    assert pick(tag="apple,b") == ["1"] and pick(tag="a\\b") == ["3"] and pick(tag="appl_") == ["1", "5"]
    assert pick(after="2022-05-01") == ["1", "2", "4", "5"] and pick(before="2022-05-01") == [] and pick(before="2022-05-02") == ["4"]
    assert pick(status="draft", tag="apple") == ["5"] and pick(doc_type="page") == ["4"]
    assert ids(filters.changed_since(rows, "2024-01-01T00:00:00.000Z")) == []
    assert len(ids(filters.changed_since(rows, None))) == 5


# --- merge and sync ---------------------------------------------------------------------------
def test_merge(spark):
    current = docs_of(spark, doc("1"), doc("2"))
    batch = docs_of(spark, doc("2", title="new"), doc("3", title="first"), doc("3", title="last")).withColumn("seq", F.monotonically_increasing_id())
    merged = merging.merge_documents(current, batch, ["seq"])
    assert {r["id"]: r["title"] for r in merged.collect()} == {"1": "Garden notes", "2": "new", "3": "last"}
    assert merging.merge_counts(current, batch).first().asDict() == {"added": 1, "updated": 2}
    assert merging.merge_counts(current, batch.limit(0)).first().asDict() == {"added": 0, "updated": 0}
    live = spark.createDataFrame([("1",), ("9",)], "id string")
    assert ids(merging.prune(merged, live)) == ["1"] and merging.removed_count(merged, live).first()["removed"] == 2
    plan = merging.last_records(batch, ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def landing(spark, posts=(), pages=(), page=1, of=1):
    made = [records(spark, list(items), t, page=page, pages=of, total=len(items)) for t, items in (("post", posts), ("page", pages))]
    return made[0].unionByName(made[1])


def entry(id, day, **more):
    return {"id": id, "updated_at": f"2024-{day}T00:00:00.000Z", **more}


def held(spark, root):
    state = archive.read_state(spark, f"{root}/state")
    return archive.read_archive(spark, root), archive.state_value(state, archive.LAST_SYNC)


def written(root):
    """Snapshots and segments below a folder, with their files' bytes."""
    folders = [p for p in Path(root).iterdir() if p.name != "state"]
    return {p.name: sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in folders}


def test_runs_one_after_the_other(spark):
    root = scratch_path(spark, "sync")
    run = lambda pages, now, **kw: sync.run_sync(spark, pages, root, SITE, now=now, **kw)
    first = run(landing(spark, [entry("m", "01-05"), entry("n", "01-06")], [entry("o", "01-07")]), "2024-02")
    assert first == {"added": 3, "updated": 0, "removed": 0, "seen_post": 2, "seen_page": 1}
    with pytest.raises(Exception, match="no id"):
        run(landing(spark, [entry("z", "03-01"), {"title": "nameless"}]), "2024-04")
    assert held(spark, root)[1] == "2024-02"
    late = landing(spark, [entry("m", "01-20", title="too old"), entry("z", "03-01")])
    second = run(late, "2024-04", live_pages=landing(spark, [entry("m", "01-20"), entry("z", "03-01")]))
    assert second == {"added": 1, "updated": 0, "removed": 2, "seen_post": 1, "seen_page": 0}
    docs, mark = held(spark, root)
    assert {r["id"]: r["title"] for r in docs.collect()} == {"m": "(untitled)", "z": "(untitled)"} and mark == "2024-04"
    assert run(late, "2024-05", full=True)["updated"] == 2
    assert archive.state_value(archive.read_state(spark, f"{root}/nowhere"), "key") is None


def test_a_landing_with_missing_pages_changes_nothing(spark):
    root = scratch_path(spark, "sync")
    whole = landing(spark, [entry("m", "01-05")], of=2).unionByName(landing(spark, [entry("n", "01-06")], page=2, of=2))
    sync.run_sync(spark, whole, root, SITE, now="2024-02")
    part = landing(spark, [entry("m", "03-05")], of=2)
    only_posts = whole.where("type = 'post'")
    unnumbered = whole.unionByName(records(spark, [entry("x", "03-01")])).unionByName(records(spark, [entry("y", "03-01")]))
    for pages, live in ((part, None), (only_posts, None), (whole, part), (whole, only_posts), (unnumbered, None), (whole.limit(0), None)):
        with pytest.raises(sync.IncompleteLanding):
            sync.run_sync(spark, pages, root, SITE, full=True, live_pages=live, now="2024-06")
    nameless = landing(spark, [entry("m", "01-05"), {"title": "nameless"}])
    with pytest.raises(Exception, match="no id"):
        sync.run_sync(spark, whole, root, SITE, live_pages=nameless, now="2024-06")
    docs, mark = held(spark, root)
    assert ids(docs) == ["m", "n"] and mark == "2024-02"


def test_of_an_id_in_two_types_the_page_stays(spark):
    root = scratch_path(spark, "sync")
    sync.run_sync(spark, landing(spark, [entry("m", "05-01")], [entry("m", "01-01")]), root, SITE, now="2024-06")
    assert [r["type"] for r in held(spark, root)[0].collect()] == ["page"]


def test_an_archive_may_be_empty(spark):
    root = scratch_path(spark, "sync")
    nothing = landing(spark)
    assert sync.run_sync(spark, nothing, root, SITE, now="2024-01")["added"] == 0
    assert held(spark, root)[0].count() == 0
    assert sync.run_sync(spark, landing(spark, [entry("m", "02-01")]), root, SITE, now="2024-02")["added"] == 1
    assert sync.run_sync(spark, nothing, root, SITE, live_pages=nothing, now="2024-03")["removed"] == 1
    assert sync.run_sync(spark, landing(spark, [entry("m", "04-01")]), root, SITE, now="2024-04")["added"] == 1
    assert feed.current_documents(spark, scratch_path(spark, "no-feed")).count() == 0
    base = docs_of(spark, doc("b"))
    assert ids(feed.current_documents(spark, scratch_path(spark, "no-feed"), base)) == ["b"]


def test_page_sets_are_committed_one_by_one(spark):
    root = scratch_path(spark, "sync")
    one, two = landing(spark, [entry("m", "01-05")], of=2), landing(spark, [entry("n", "01-06")], page=2, of=2)
    broken = two.unionByName(api_pages.parse_pages(bodies(spark, "<html>"), "post"))
    with pytest.raises(Exception):
        sync.run_page_sets(spark, [one, broken], root, SITE, now="2024-02")
    docs, mark = held(spark, root)
    assert ids(docs) == ["m"] and mark is None
    with pytest.raises(sync.IncompleteLanding):
        sync.run_page_sets(spark, [one], root, SITE, now="2024-02")
    assert held(spark, root)[1] is None
    for _ in range(2):
        sync.run_page_sets(spark, [one, two], root, SITE, full=True, now="2024-02")
        docs, mark = held(spark, root)
        assert ids(docs) == ["m", "n"] and mark == "2024-02"


def test_runs_append_segments_and_fold_them_once(spark, monkeypatch):
    monkeypatch.setattr(sync, "FOLD_SHARE", 100)
    root = scratch_path(spark, "sync")
    run = lambda items, now, **kw: sync.run_sync(spark, landing(spark, items), root, SITE, now=now, **kw)
    listing = lambda *names: landing(spark, [entry(n, "01-01") for n in names])
    run([entry(f"k{i}", "01-05", title=f"first {i}", plaintext=f"{i} " * 5000) for i in range(40)], "2024-02")
    before = written(root)
    assert [n.startswith("snapshot-") for n in before] == [True]
    run([entry("k1", "02-05", title="second"), entry("n", "02-05")], "2024-03")
    pruned = run([entry("k1", "03-05", title="third"), entry("k2", "03-05")], "2024-04", live_pages=listing("k1", "n", "k5"))
    assert pruned["removed"] == 38 and pruned["updated"] == 2
    now = written(root)
    assert all(now[n] == before[n] for n in before)
    assert len(now) == 3 and max(size for n, size in now.items() if n not in before) < sum(before.values()) / 4
    titles = lambda: {r["id"]: r["title"] for r in held(spark, root)[0].collect()}
    want = {"k1": "third", "n": "(untitled)", "k5": "first 5"}
    assert titles() == want
    run([entry("k3", "04-05", title="back")], "2024-05")
    run([], "2024-06")
    # A run without changes writes its watermark alone.
    assert len(written(root)) == 4 and titles() == want | {"k3": "back"} and held(spark, root)[1] == "2024-06"
    assert sync.fold(spark, root) and not sync.fold(spark, root)
    assert titles() == want | {"k3": "back"} and held(spark, root)[1] == "2024-06"
    assert archive.live_segments(archive.read_state(spark, f"{root}/state")) == {}
    monkeypatch.setattr(sync, "FOLD_SHARE", 0.25)
    run([entry("k3", "06-05", title="again")], "2024-07")
    assert archive.live_segments(archive.read_state(spark, f"{root}/state")) == {}
    assert titles() == want | {"k3": "again"}


def test_a_segment_that_no_state_names_is_not_read(spark):
    root = scratch_path(spark, "sync")
    sync.run_sync(spark, landing(spark, [entry("m", "01-05")]), root, SITE, now="2024-02")
    archive.write_segment(docs_of(spark, doc("lost")), spark.createDataFrame([("m",)], "id string"), f"{root}/changes-9", 9)
    assert ids(held(spark, root)[0]) == ["m"]


def test_page_sets_count_types_and_prune_at_the_end(spark):
    root = scratch_path(spark, "sync")
    one = landing(spark, [entry("m", "01-05"), entry("x", "01-05")], [entry("p", "01-05")], of=2)
    two = landing(spark, [entry("n", "01-06"), entry("m", "01-07", title="later")], page=2, of=2)
    live = landing(spark, [entry("m", "01-05"), entry("n", "01-06")], [entry("p", "01-05")])
    got = sync.run_page_sets(spark, [one, two], root, SITE, live_pages=live, now="2024-02")
    assert got == {"added": 4, "updated": 1, "removed": 1, "seen_post": 4, "seen_page": 1}
    docs, mark = held(spark, root)
    assert {r["id"]: r["title"] for r in docs.collect()} == {"m": "later", "n": "(untitled)", "p": "(untitled)"}
    assert mark == "2024-02"
    part = landing(spark, [entry("m", "01-05")], of=2)
    with pytest.raises(sync.IncompleteLanding):
        sync.run_page_sets(spark, [one, two], root, SITE, live_pages=part, now="2024-03")
    assert held(spark, root)[1] == "2024-02"


# --- index ------------------------------------------------------------------------------------
def same_rows(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def counted(n, *words):
    """A body in which every word stands `n` times, with a number between."""
    return ". ".join(f"{w} {i}" for i in range(n) for w in words)


def test_updating_the_index_equals_building_it(spark):
    old = docs_of(spark, doc("p", plaintext=counted(2, "granite", "basalt")), doc("q", plaintext=counted(3, "slate")), doc("r", plaintext=""))
    new = [doc("p", title="Stones", plaintext=counted(1, "marble")), doc("s", tags=("quarry",), plaintext=counted(2, "chalk"))]
    index = build_index(spark, old, scratch_path(spark, "i"), 3)
    updated = update_index(spark, index, docs_of(spark, *new), scratch_path(spark, "i"), spark.createDataFrame([("q",)], "id string"))
    built = build_index(spark, docs_of(spark, *new, doc("r", plaintext="")), scratch_path(spark, "i"), 3)
    assert same_rows(updated.postings, built.postings) and same_rows(updated.vocab, built.vocab)
    assert same_rows(updated.documents, built.documents)
    assert (updated.n_docs, updated.avg_len) == (built.n_docs, built.avg_len)
    for word, want in (("granite", []), ("basalts", []), ("slate", []), ("marbles", ["p"]), ("stone", ["p"]), ("quarry", ["s"]), ("chalk", ["s"])):
        assert ids(search(updated, spark, word)) == want, word


def test_postings_hold_every_token(spark, sf_dir):
    docs = testtables.archive(spark, sf_dir)
    rows = indexing.build_postings(docs)
    spread = rows.select("id", "col", F.explode("positions").alias("pos"), "term")
    assert same_rows(spread, indexing.tokenize(docs))
    counted = rows.groupBy("id").agg(F.sum("n_places").alias("n"), F.max("n_tokens").alias("m"))
    assert counted.where("n <> m").count() == 0
    assert rows.groupBy("term", "id").agg(F.count_if("lead").alias("n")).where("n <> 1").count() == 0


def test_folding(spark):
    texts = {"Café naïve": ["cafe", "naive"], "Straße x_y": ["straße", "x", "y"], "Cafés": ["cafes"], "½ ΟΔΟΣ": ["½", "οδοσ"], "日本語 ok": ["日本語", "ok"]}
    from inkwell.functions.text import terms

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", terms(F.col("t")).alias("l"))
    assert {r["t"]: r["l"] for r in df.collect()} == texts


# --- search -----------------------------------------------------------------------------------
WORDS = ("amber", "birch", "cedar")


def held_words(n):
    """Document n holds the words whose bits n has."""
    return [w for k, w in enumerate(WORDS) if n >> k & 1]


@pytest.fixture(scope="module")
def small_index(spark):
    rows = [
        doc(f"k{n}", title=" ".join(held_words(n)[:1] * n), plaintext=" ".join(held_words(n)), tags=("even" if n % 2 == 0 else "odd",),
            type="page" if n == 7 else "post", published_at=f"{2010 + n}-06-15T00:00:00.000Z")
        for n in range(8)
    ]
    return build_index(spark, docs_of(spark, *rows), scratch_path(spark, "small"), 2)


def found_by(spark, index, rows, limit=None):
    hits = search_batch(index, spark.createDataFrame(rows, "query_id long, raw string, prefix_last boolean"), limit)
    got = {i: [] for i, _, _ in rows}
    for r in hits.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["id"])
    return got


def test_boolean_searches_follow_the_bits(spark, small_index):
    """Every choice of wanted and unwanted words, with and without a filter."""
    cases = {}
    for wanted in range(1, 8):
        for unwanted in range(8):
            if not wanted & unwanted:
                text = " ".join(held_words(wanted) + [f"-{w}" for w in held_words(unwanted)])
                fits = [n for n in range(8) if n & wanted == wanted and not n & unwanted]
                cases[text] = fits
                cases[f"{text} tag:odd"] = [n for n in fits if n % 2]
                cases[f"{text} after:2014"] = [n for n in fits if n >= 4]
                cases[f"type:page {text}"] = [n for n in fits if n == 7]
    rows = [(i, text, False) for i, text in enumerate(cases)]
    got = found_by(spark, small_index, rows)
    for i, text, _ in rows:
        assert sorted(got[i]) == [f"k{n}" for n in cases[text]], text


def test_phrases_titles_prefixes_and_dates(spark, small_index):
    cases = [
        ('"amber birch"', False, {3, 7}), ('"amber cedar"', False, {5}), ('"birch amber"', False, set()), ("title:birch", False, {2, 6}),
        ("title:cedar", False, {4}), ("ced", False, set()), ("ced", True, {4, 5, 6, 7}), ("ambers", False, {1, 3, 5, 7}), ("unheard", False, set()),
    ]
    got = found_by(spark, small_index, [(i, text, typed) for i, (text, typed, _) in enumerate(cases)])
    for i, (text, _, want) in enumerate(cases):
        assert set(got[i]) == {f"k{n}" for n in want}, text
    newest = [f"k{n}" for n in reversed(range(8))]
    assert found_by(spark, small_index, [(0, "", False), (1, "tag:even", False)]) == {0: newest, 1: newest[1::2]}


def test_limits(spark, small_index):
    assert ranking.effective_limit(None) == ranking.effective_limit(0) == ranking.effective_limit(-3) == 50
    for limit in (1, 3, 2000):
        got = found_by(spark, small_index, [(0, "", False), (1, "cedar", False)], limit)
        assert len(got[0]) == min(limit, 8) and len(got[1]) == min(limit, 4)


@pytest.mark.parametrize("limit", [10, 5000])
def test_groups_are_cut_before_they_meet(spark, limit):
    rows = spark.range(30_000, numPartitions=6).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("v"), "id")
    top = ranking.top_rows(rows, ["g"], [F.col("v"), F.col("id")], limit)
    assert top.groupBy("g").agg(F.count("*").alias("n"), F.max("rank").alias("r")).select("n", "r").distinct().collect() == [(limit, limit)]
    everything = rows.orderBy("v", "id").where("g = 1").limit(limit)
    assert same_rows(top.where("g = 1").select("v", "id"), everything.select("v", "id"))
    assert top._jdf.queryExecution().executedPlan().toString().count("row_number") >= 2


def test_one_long_string_stays_linear(spark, small_index):
    """A string of many words: rows that carry keys don't carry the string."""
    from inkwell.plans.search import distinct_queries, read_log

    text = " ".join(f"w{i}" for i in range(20_000))
    log = spark.createDataFrame([(0, text, False)], "query_id long, raw string, prefix_last boolean")
    parsed = read_log(distinct_queries(log)[1])
    widths = parsed.clauses.select(F.max(F.length("query_id") + F.length("clause_key")).alias("n"), F.count("*").alias("rows")).first()
    assert widths["rows"] == 20_000 and widths["n"] < 200


def test_a_string_that_fills_the_log(spark, small_index):
    """Equal strings are searched once and answered for every row."""
    log = spark.range(3000).select(F.col("id").alias("query_id"), F.when(F.col("id") % 3 == 0, "title:birch").otherwise(F.concat(F.lit("w"), "id")).alias("raw"), F.lit(False).alias("prefix_last"))
    hits = search_batch(small_index, log)
    assert hits.count() == 2000 and hits.select("query_id").distinct().count() == 1000


def test_search_reads_only_wanted_buckets(spark, small_index):
    log = spark.createDataFrame([(0, "cedar", False), (1, "birch", False)], "query_id long, raw string, prefix_last boolean")
    assert "dynamicpruning" in search_batch(small_index, log)._jdf.queryExecution().executedPlan().toString()


def test_one_search_fetches_bodies_by_one_scan_with_the_ids_as_values(spark, small_index):
    plan = search(small_index, spark, "cedar")._jdf.queryExecution().executedPlan().toString()
    (scan,) = [line for line in plan.splitlines() if "FileScan" in line]
    assert "EqualTo(id,k4)" in scan and "id_bucket" in scan and "dynamicpruning" not in plan


def test_an_empty_archive_can_be_searched_and_filled(spark):
    empty, silent = docs_of(spark), docs_of(spark, doc("t", title="...", plaintext="", tags=()))
    for docs in (empty, silent):
        index = build_index(spark, docs, scratch_path(spark, "i"), 2)
        assert search(index, spark, "cedar").count() == 0 and search(index, spark, "").count() == docs.count()
        filled = update_index(spark, index, docs_of(spark, doc("u", plaintext="cedar")), scratch_path(spark, "i"))
        assert ids(search(filled, spark, "cedar")) == ["u"]


# --- streams ----------------------------------------------------------------------------------
def test_feed_keeps_the_newest_row_in_any_order(spark, tmp_path):
    landing, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    landing.mkdir()

    def land(name, *items):
        (landing / name).write_text(json.dumps({"posts": list(items)}))
        feed.stream_archive(spark, str(landing), out, marks, "post", SITE).awaitTermination()

    land("1.json", {"id": "x", "title": "newer", "updated_at": "2024-02"}, {"id": "y", "title": "y1", "updated_at": "2024-01", "plaintext": "first words"})
    land("2.json", {"id": "x", "title": "older", "updated_at": "2024-01"}, {"id": "y", "title": "y2", "updated_at": "2024-01", "plaintext": "second words"})
    got = {r["id"]: r["title"] for r in feed.current_documents(spark, out).collect()}
    assert got == {"x": "newer", "y": "y2"}
    postings = feed.current_postings(spark, out)
    assert same_rows(postings, indexing.build_postings(feed.current_documents(spark, out)))
    base = docs_of(spark, doc("x", title="base", updated_at="2025"), doc("z"))
    got = {r["id"]: r["title"] for r in feed.current_documents(spark, out, base).collect()}
    assert got == {"x": "base", "y": "y2", "z": "Garden notes"}


def test_a_scratch_folder_is_chosen_once_where_none_is_named():
    from types import SimpleNamespace

    from inkwell.session import shared_root

    def session(named, master="local[4]"):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(applicationId="app", master=master))

    assert shared_root(session("/shared/marks/", "spark://host:7077")) == "/shared/marks"
    assert shared_root(session(None)) == shared_root(session(None, "local")) != ""
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            shared_root(session(None, master))
