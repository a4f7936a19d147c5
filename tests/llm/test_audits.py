"""Filter audit, conversation repair and host rules against plain loops."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from inkwell.llm import conversations, filteraudit, hostrules
from inkwell.llm.textscan import Texts, blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"
TALK = "conv_id long, turn long, role string, text string"


# --- texts as bytes ------------------------------------------------------------------------
def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    places = defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), len(set(words)), len(covered), len(lines), len(lines) - len(set(lines))


def test_texts():
    draw = random.Random(1)
    for _ in range(300):
        texts = [draw.choice([None, "", "".join(draw.choice("ab \n\té.\x1c") for _ in range(draw.randrange(60)))]) for _ in range(draw.randrange(9))]
        own = Texts(pa.array(["zz q", *texts], pa.string()).slice(1))
        found = zip(*(x.tolist() for x in (own.n_words(), own.n_distinct(), own.repeated_words(5), *own.lines())))
        assert list(found) == [plain_counts(t) for t in texts]


def test_blocks(monkeypatch):
    monkeypatch.setattr("inkwell.llm.textscan.BLOCK", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 25, None, "b" * 4, "", "c" * 5, "d" * 30, "e"])], ["text"])
    parts = [b["text"].to_pylist() for b in blocks([batch, batch.slice(0, 0)])]
    assert [t for p in parts for t in p] == batch["text"].to_pylist() and len(parts) > 3


# --- filter audit --------------------------------------------------------------------------
def plain_mask(text, doc_id, least):
    words = WORD.findall(text)
    capitals, marks = sum("A" <= c <= "Z" for c in text), any(c in "#$%&*|" for c in text)
    fails = (
        len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text), marks,
        doc_id is not None and doc_id > least.get(text, doc_id),
    )
    return {f for f, failed in zip("ABCDE", fails) if failed}


def plain_audit(rows, labels):
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(r.doc_id, least.get(r.text or "", r.doc_id))
    good, toxic = {r[0] for r in labels if r[1] == 1}, {r[0] for r in labels if r[2] == 1}
    masks = [(r.lang or "", plain_mask(r.text or "", r.doc_id, least), r.doc_id) for r in rows]
    found, shapley = {}, Counter()
    for part in {p for p, _, _ in masks}:
        own = [(m, d) for p, m, d in masks if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(m, d) for m, d in left if name in m]
                left = [(m, d) for m, d in left if name not in m]
                shapley[part, name] += len(gone)
                found[part, order, step] = (
                    len(left), len(gone), sum(name in m for m, _ in own) - len(gone), sum(m == {name} for m, _ in own),
                    sum(d in good for _, d in gone if d is not None), sum(d in toxic for _, d in gone if d is not None),
                )
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def audit_rows(frame):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in frame.collect()}


def test_audit(spark, sf_dir, nasty, nothing):
    own = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    assert audit_rows(filteraudit.audit(own, labels)) == plain_audit(own.collect(), labels.collect())
    odd = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (6, None, 1), (None, 1, 1), (7, 1, None)], LABELS)
    assert audit_rows(filteraudit.audit(nasty, odd)) == plain_audit(nasty.collect(), odd.collect())
    assert filteraudit.audit(nothing, labels).collect() == []
    empty = audit_rows(filteraudit.audit(nasty, odd.limit(0)))
    assert {(v[4], v[5]) for v in empty.values()} == {(0, 0)} and len(empty) == 600 * len({r.lang for r in nasty.select("lang").collect()})


@pytest.mark.parametrize("bits, part_bits", [(3, 3), (10, 10), (12, 6)])
def test_sketch(spark, monkeypatch, bits, part_bits):
    """A sketch too small for its rows clears fewer texts, but never one that repeats."""
    monkeypatch.setattr(filteraudit, "PART_BITS", part_bits)
    keys = [hash((i, "x")) for i in range(200)] + [7, 7, -1, -1, 2**63 - 1] + [5] * 300
    rows = spark.createDataFrame([(k,) for k in keys], "key long").repartition(7)
    parts = {r.part: bytes(r.twice) for r in filteraudit.sketch(rows, bits).collect()}
    seen = filteraudit.Sketch(parts, bits)
    import numpy as np

    repeats = dict(zip(keys, seen.may_repeat(np.array(keys, np.int64)).tolist()))
    assert all(repeats[k] for k, n in Counter(keys).items() if n > 1)
    if bits >= 10:
        assert sum(repeats.values()) < 150


def test_small_sketch_gives_the_same_flags(spark, sf_dir, monkeypatch):
    own = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(map(tuple, filteraudit.flags(own).collect()))
    monkeypatch.setattr(filteraudit, "MAX_SLOT_BITS", 3)
    assert sorted(map(tuple, filteraudit.flags(own).collect())) == want


# --- conversations -------------------------------------------------------------------------
def damaged(rows):
    """Rows as (conv_id, turn, role, text), in no order; dropped rows are left out."""
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 0:
            continue
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if case == 3 else 1)


def plain_repair(rows):
    """Result of one conversation by trying edits of all rows, cheapest first by a plain search over whole audits."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        solid = WORD.sub(lambda m: m[0], text).rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
    # Of every place reached: the best (cost, audit, lines) so far, whole audits compared.
    leads = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(ways):
        ways = dict(ways)
        for _ in range(4):
            for place, (cost, audit, lines) in list(ways.items()):
                for letter, name in (("u", "user"), ("a", "assistant")):
                    if (place, letter) in leads:
                        to = leads[place, letter]
                        new = (cost + 2, audit + "I", (*lines, f"{name}:"))
                        ways[to] = min(ways.get(to, new), new, key=lambda w: w[:2])
        return ways

    # Audits that may still be followed by anything: all of the least cost of a place, by trying every row's edits.
    ways = {"": [(0, "", ())]}
    for (_, _, role, text), fault in zip(rows, faults):
        after = defaultdict(list)
        for place, held in ways.items():
            for way in held:
                for at, (cost, audit, lines) in inserted({place: way}).items():
                    after[at].append((cost + 3, audit + "D", lines))
                    if fault in ("blank", "duplicate"):
                        continue
                    extra = fault == "truncated"
                    if (at, role[:1]) in leads:
                        after[leads[at, role[:1]]].append((cost + extra, audit + "K", (*lines, f"{role}:{text}")))
                    for letter, name in (("u", "user"), ("a", "assistant")):
                        if (at, letter) in leads:
                            after[leads[at, letter]].append((cost + 2 + extra, audit + "R", (*lines, f"{name}:{text}")))
        ways = {p: [w for w in set(held) if w[0] == min(x[0] for x in held)] for p, held in after.items()}
    ends = [w for place, held in ways.items() for way in held for at, w in inserted({place: way}).items() if at in ("", "a")]
    cost, audit, lines = min(ends, key=lambda w: w[:2]) if rows else (0, "", ())
    turns = sorted({r[1] for r in rows if r[1] is not None})
    initials = [r[2][:1] for r in rows]
    return (
        turns[-1] - turns[0] + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def test_repair_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = defaultdict(list)
    for r in damaged(rows):
        by[r[0]].append(r)
    got = conversations.op12_conversation_repair(spark, sf_dir).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: plain_repair(by[c]) for c in {r[0] for r in rows}}
    assert len(got) == len({r.conv_id for r in got}) and sum(r.duplicate for r in got) and sum(r.gaps for r in got)


def hard_talk(seed, n):
    draw = random.Random(seed)
    for conv in range(n):
        for at in range(draw.randrange(1, 12)):
            turn = draw.choice([at, at, at, draw.randrange(5), None])
            yield conv if conv else None, turn, draw.choice(["system", "user", "assistant", "tool", "", None, "User", "sys"]), draw.choice(
                ["Yes.", "No", "Why?", "", " \n", None, "é!", "Go on. \t", f"text {at}."]
            )


@pytest.mark.parametrize("kept", [1, 2, 1 << 20])
def test_repair_of_hard_conversations(spark, monkeypatch, kept):
    monkeypatch.setattr(conversations, "KEPT_ROWS", kept)
    rows = list(hard_talk(kept, 150))
    frame = spark.createDataFrame([(*r, "other") for r in rows], TALK + ", digest string").repartition(3)
    for change, make in ((damaged, lambda f: conversations.repair(conversations.with_faults(conversations.damage(f)))),
                         (lambda x: ((c, t, " " if r is None else r, " " if s is None else s) for c, t, r, s in x), conversations.repair_conversations)):
        by = defaultdict(list)
        for r in change(rows):
            by[r[0]].append(r)
        got = make(frame).collect()
        assert {r.conv_id: tuple(r)[1:] for r in got} == {c: plain_repair(by[c]) for c in {r[0] for r in rows}}
        assert make(frame.limit(0)).collect() == []


def test_long_conversation(spark):
    """All rows in one conversation, over many Arrow batches, with turns and texts that repeat."""
    rows = [(1, i // 2, ("user", "assistant")[i % 2], "Same.") if i % 3 else (1, i, "user", f"Text {i}.") for i in range(30_000)]
    (got,) = conversations.repair_conversations(spark.createDataFrame(rows, TALK).repartition(5)).collect()
    assert got.duplicate == sum(n - 1 for n in Counter((r, t) for _, _, r, t in rows).values())
    assert sum(got.audit.count(x) for x in "DKR") == len(rows) and got.audit.count("D") >= got.duplicate


# --- host rules ----------------------------------------------------------------------------
def plain_rules(rows):
    facts = []
    for r in rows:
        text = r.text or ""
        n, _, repeats, n_lines, dups = plain_counts(text)
        chars, symbols = sum(map(len, WORD.findall(text))), sum(c in "#*$%&|<>" for c in text)
        fails = (n < 10, 100 * repeats > 20 * n, 10 * symbols > n, 10 * dups > 3 * n_lines, chars < 3 * n or chars > 10 * n)
        facts.append((r.doc_id, r.source, n, chars, symbols, dups, repeats, fails))
    hosts = defaultdict(list)
    for f in facts:
        if f[1] is not None:
            hosts[f[1]].append(f[-1])
    bad = set()
    for rule in range(5):
        counts = {h: (len(v), sum(x[rule] for x in v)) for h, v in hosts.items()}
        docs, fails = sum(n for n, _ in counts.values()), sum(f for _, f in counts.values())
        mean, spread = (fails / docs if docs else 0), 0
        freedom = docs - sum(n * n for n, _ in counts.values()) / docs - (len(counts) - 1) if docs else 0
        if 0 < mean < 1 and freedom > 0:
            between = sum(n * (f / n - mean) ** 2 for n, f in counts.values()) / (mean * (1 - mean))
            spread = (between - (len(counts) - 1)) / freedom
        weight = 1 / min(max(spread, 1e-6), 1 - 1e-6) - 1
        bad |= {h for h, (n, f) in counts.items() if (f + mean * weight) / (n + weight) > 0.5}
    return sorted(str((*f[:1], *f[2:7], f[-1][0] or f[-1][1], f[1] in bad, not (f[-1][0] or f[-1][1] or f[1] in bad))) for f in facts), bad


def rule_rows(frame):
    return sorted(
        str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.host_failed, r.kept))
        for r in frame.collect()
    )


def test_host_rules(spark, sf_dir, nasty, nothing):
    own = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for docs in (own, nasty):
        want, _ = plain_rules(docs.collect())
        assert rule_rows(hostrules.quality_rules(docs)) == want
    assert hostrules.quality_rules(nothing).collect() == []


def test_bad_hosts_go_whole_but_small_ones_are_shrunk(spark):
    good, bad = " ".join(f"word{i} is here" for i in range(20)), " ".join(f"#{i} $ % here" for i in range(20))
    rows = [(i, good, "good") for i in range(60)] + [(100 + i, bad if i % 10 else good, "bad") for i in range(50)]
    rows += [(200 + i, good, f"h{i % 6}") for i in range(60)] + [(300, bad, "tiny"), (301, bad, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    want, gone = plain_rules(docs.collect())
    got = hostrules.quality_rules(docs)
    assert rule_rows(got) == want and "bad" in gone and "good" not in gone
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert not kept[100] and not kept[101] and kept[0] and kept[301]
    (tiny,) = hostrules.host_rates(hostrules.document_facts(docs)).where("host = 'tiny'").collect()
    assert 0 < tiny.symbols < 1 and tiny.n_docs == 1
