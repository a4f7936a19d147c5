"""The pipeline's stages against brute-force versions, one after the other."""

import re

import pytest
from test_exact_and_near import classes, plain_fingerprint
from test_scans import plain_leaks
from tokenizers import Tokenizer

import corpus_pipeline
from inkwell.llm import bpe, quality

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """Documents with some repeated rows and rows without an id."""
    own = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame([(None, "a row without an id", "en", "s", 1), (None, None, None, None, None)], own.schema)
    return own.unionByName(own.where("doc_id % 50 = 0")).unionByName(more)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_stage_list(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding",
    ]


def test_quality_stage(spark, docs, sf_dir):
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = [r for r in docs.collect() if model.scores([r.text or ""])[0] >= 0.3]
    got = STAGE["quality classifier"](spark, docs, sf_dir)
    assert got.columns == docs.columns and rows_of(got) == sorted(map(tuple, want), key=str)
    assert 0 < len(want) < docs.count()


def one_of_each(rows, group, rank):
    """Of each group one row, the least by rank; rows alike in rank are equal but for their place."""
    best = {}
    for r in rows:
        key = group(r)
        if key not in best or rank(r) < rank(best[key]):
            best[key] = r
    return sorted(map(tuple, best.values()), key=str)


def test_exact_stage(spark, docs, sf_dir):
    norm = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
    want = one_of_each(docs.collect(), norm, lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
    assert rows_of(STAGE["exact dedup"](spark, docs, sf_dir)) == want and len(want) < docs.count()


def test_near_stage(spark, docs, sf_dir):
    rows = docs.collect()
    prints = {r: plain_fingerprint(r.text) for r in rows}
    distinct = sorted(set(prints.values()))
    root = classes([(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 2], distinct)
    want = one_of_each(rows, lambda r: root[prints[r]], lambda r: (r.doc_id is None, r.doc_id or 0))
    assert rows_of(STAGE["SimHash near-dedup"](spark, docs, sf_dir)) == want and len(want) < len(rows)


def test_decontamination_stage(spark, docs, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = [r for r in docs.collect() if not plain_leaks(r.text, items)]
    got = STAGE["benchmark decontamination"](spark, docs, sf_dir)
    assert rows_of(got) == sorted(map(tuple, want), key=str) and len(want) < docs.count()


def test_tokens_stage(spark, docs, sf_dir):
    library = Tokenizer.from_file(bpe.VOCABULARY)
    want = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    got = STAGE["BPE encoding and decoding"](spark, docs, sf_dir)
    assert sorted(str((r.doc_id, r.ids)) for r in got.collect()) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["exact dedup", "SimHash near-dedup"])
def test_one_row_of_each_group(spark, sf_dir, name):
    """Repeated rows, rows without an id and copies among them: one row of each group stays."""
    texts = ["alpha beta gamma delta epsilon", "one two three four five six", "seven eight nine ten eleven"]
    rows = [(5, texts[0]), (5, texts[0]), (3, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (9, texts[2]), (9, texts[2])]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row_key long").repartition(3)
    got = STAGE[name](spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted([("3", texts[0]), ("None", texts[1]), ("9", texts[2])])


def test_run_and_hard_rows(spark, sf_dir, nasty, nothing):
    assert 0 < corpus_pipeline.run(spark, sf_dir).count() < spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    plain = nasty.select("doc_id", "text", "lang", "source", "n_chars", "fp", "hash", "kept", "lost")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, plain, sf_dir)
        assert name.startswith("BPE") or got.columns == plain.columns
        got.collect()
        assert stage(spark, nothing, sf_dir).collect() == []
