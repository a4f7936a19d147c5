"""SimHash classes, exact groups, components and shards against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from compare import connect, rows_of
from pyspark.sql import functions as F

from inkwell.llm import exactdedup, graph, queries, sharding, simhash


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) > 2 else ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_near(docs):
    rows = docs.select("doc_id", "text").collect()
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    distinct = sorted(set(prints))
    near = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 2]
    root = classes(near, distinct)
    least = {}
    for r, p in zip(rows, prints):
        if r.doc_id is not None:
            least[root[p]] = min(r.doc_id, least.get(root[p], r.doc_id))
    want = Counter((r.doc_id, p, least.get(root[p])) for r, p in zip(rows, prints))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want


def test_near_duplicates(spark, sf_dir, nasty, nothing):
    check_near(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    check_near(nasty)
    assert simhash.near_duplicates(nothing).collect() == []


def test_many_tiles_in_a_cell(spark, monkeypatch):
    """Fingerprints of one cell, cut into small tiles, and neighbours within and beyond the radius."""
    rng = np.random.default_rng(1)
    keys = {0, 3, 7 << 40, -1}
    for base in rng.integers(-(2**63), 2**63, 20):
        for _ in range(15):
            flips = 0
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                flips |= 1 << int(bit)
            keys.add(int(np.uint64(int(base) % 2**64 ^ flips).astype(np.int64)))
    monkeypatch.setattr(simhash, "TILE", 3)
    links = simhash.near_links(spark.createDataFrame([(k,) for k in keys], "fp long")).collect()
    assert all(0 < ((a ^ b) % 2**64).bit_count() <= 2 for a, b in links)
    near = [(a, b) for a in keys for b in keys if a < b and ((a ^ b) % 2**64).bit_count() <= 2]
    assert classes([(r.a, r.b) for r in links], keys) == classes(near, keys)


def test_forest_keeps_classes():
    rng = np.random.default_rng(2)
    for share in (0.02, 0.3, 1.0):
        hit = rng.random((40, 30)) < share
        nodes = [("r", i) for i in range(40)] + [("c", j) for j in range(30)]
        as_links = lambda pairs: [(("r", int(i)), ("c", int(j))) for i, j in pairs]
        forest = simhash._forest(hit)
        assert all(hit[i, j] for i, j in forest) and len(forest) <= 70
        assert classes(as_links(forest), nodes) == classes(as_links(zip(*np.nonzero(hit))), nodes)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 100), (7, 7), (None, 3), (500, 400)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 105: 100, 400: 400, 500: 400}


def check_exact(docs, capacity):
    rows = docs.select("doc_id", "text").collect()
    got = exactdedup.exact_duplicates(docs, capacity).collect()
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for r in rows:
        groups[norm(r.text)].append(r)
    order = lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)
    keep = {k: min(g, key=order).doc_id for k, g in groups.items()}
    want = Counter((r.doc_id, keep[norm(r.text)], len(groups[norm(r.text)]), r.doc_id == keep[norm(r.text)]) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want


@pytest.mark.parametrize("capacity", [2, 4096])
def test_exact_duplicates(spark, sf_dir, nasty, nothing, capacity):
    check_exact(nasty, capacity)
    if capacity == 2:
        check_exact(spark.read.parquet(f"{sf_dir}/documents.parquet"), capacity)
        assert exactdedup.exact_duplicates(nothing).collect() == []


def test_directory(spark):
    """No bucket is overfull, buckets are prefixes, and a shallow bucket has several slots."""
    rng = np.random.default_rng(5)
    hashes = [int(h) for h in rng.integers(-(2**63), 2**63, 300)] + [int(h) for h in rng.integers(0, 2**58, 200)]
    frame = spark.createDataFrame([(h,) for h in set(hashes)], "hash long")
    depth, slots = exactdedup.directory(frame, capacity=20)
    bucket = {r.slot: (r.depth, r.bucket) for r in slots.collect()}
    held = Counter(bucket[(h % 2**64) >> (64 - depth)] for h in set(hashes))
    assert max(held.values()) <= 20
    assert any(d < depth for d, _ in held) and all(b % (1 << (depth - d)) == 0 for d, b in held)


def test_exact_statement(spark, sf_dir):
    con = connect(sf_dir)
    for name, sql in queries.STATEMENTS.items():
        got = queries.QUERIES[name](spark, sf_dir)
        cursor = con.execute(sql)
        want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
        assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want, name


@pytest.mark.parametrize("cell_rows", [3, 8192])
def test_shards(spark, sf_dir, nasty, nothing, monkeypatch, cell_rows):
    monkeypatch.setattr(sharding, "CELL_ROWS", cell_rows)
    for docs in (nasty, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = docs.select("doc_id", "text", "source").collect()
        got = sharding.shards(docs).collect()
        data = lambda t: (t or "").encode()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
            (r.doc_id, len(data(r.text)) + 1, zlib.crc32(data(r.text))) for r in rows
        )
        counts = Counter(r.shard for r in got)
        assert max(counts.values()) - min(counts[s] for s in range(16)) <= 1
        for s in counts:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
        mixture = Counter(r.source or "" for r in rows)
        for s in counts:
            for source, n in Counter(r.source for r in got if r.shard == s).items():
                assert abs(n - mixture[source] / 16) <= 1 + 1e-9
        assert got and sorted(map(str, sharding.shards(docs).collect())) == sorted(map(str, got))
    assert sharding.shards(nothing).collect() == []


def test_written_shards(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sharding.write_shards(docs, sharding.shards(docs), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(docs.columns) < set(back.columns)
    assert back.agg(F.countDistinct("shard")).first()[0] == 16
