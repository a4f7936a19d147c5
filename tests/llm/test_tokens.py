"""BPE and token files against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from inkwell.llm import bpe, tokenfiles

LETTERS = "aabcdethinors  '’“.,!?0123\n\t<|>'éÉñßſΣσKİ́  \x1c\x85​漢字🙂ａ"
HARD = [
    "", " ", "  ", " a", "a ", "a  b", "a   b", "a \nb", "a\n b", "x" * 3000, "aaaaaaa" * 50, "hello" * 200, "\x1c",
    "<|endoftext|>", "a <|startoftext|>b<|ENDOFTEXT|> <|endoftext|>", "<|endoftext|> x  y", "it's 'll DON'T",
]


def strings(n):
    draw = random.Random(3)
    for _ in range(n):
        yield "".join(draw.choice(LETTERS) for _ in range(draw.randrange(50)))
        yield "".join(draw.choice("aeinorst") for _ in range(draw.randrange(30)))
        yield "".join(chr(draw.choice((draw.randrange(32, 127), draw.randrange(0x80, 0x600), draw.randrange(0x10000, 0x1FFFF)))) for _ in range(20))


def test_prefix_encoder():
    own, library = bpe.PrefixEncoder(bpe.VOCABULARY), Tokenizer.from_file(bpe.VOCABULARY)
    back = bpe.Decoder(bpe.VOCABULARY)
    for text in [*HARD, *strings(1500)]:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == want, text
        assert back.decode(want) == library.decode(want, skip_special_tokens=False)


def test_every_byte():
    """Control characters and all other bytes, alone, in pairs and inside words."""
    own, library = bpe.PrefixEncoder(bpe.VOCABULARY), Tokenizer.from_file(bpe.VOCABULARY)
    chars = [chr(i) for i in range(256)]
    texts = [*chars, *(a + b for a in chars for b in chars), *(f"wo{c}rd {c}log! x{c}" for c in chars), *(f"{c}{c}{c}1{c}" for c in chars)]
    texts += ["!\x01! log", "abc\x1b[31m red\x1b[0m", "a\x00b\x00", "\x7f\x08" * 40 + "É\x01"]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text).tolist() == want.ids, text


def test_kept_results_are_bounded_in_bytes():
    own = bpe.PrefixEncoder(bpe.VOCABULARY)
    own.encode("x" * 500 + " short " + "ab" * 40)
    assert all(len(k) <= bpe.KEPT_CHARS for r in (own.words, own.chunks) for k in r.new)


def test_results_survive_small_tables(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    own, library = bpe.PrefixEncoder(bpe.VOCABULARY), Tokenizer.from_file(bpe.VOCABULARY)
    text = " ".join(strings(40))
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_codec(nasty, nothing):
    library = Tokenizer.from_file(bpe.VOCABULARY)
    rows = {(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()}
    want = {(d, tuple(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows}
    both = bpe.decode(bpe.encode(nasty)).collect()
    assert {(r.doc_id, tuple(r.ids)) for r in both} == want and len(both) == nasty.count()
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in both)
    assert sorted(map(str, bpe.recode(nasty).collect())) == sorted(map(str, both))
    assert bpe.digests(bpe.recode(nothing)).collect() == []


def test_decode_unknown(spark):
    rows = spark.createDataFrame([(1, None), (2, [0, 10**6, 1]), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(rows).collect()} == {1: "", 2: '! "', 3: ""}


def test_piece_encoder(monkeypatch):
    library = Tokenizer.from_file(tokenfiles.VOCABULARY)
    texts = [*HARD, *strings(1500), " ".join(strings(100))]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tokenfiles.PieceEncoder(tokenfiles.VOCABULARY).encode_all(texts) == want
    monkeypatch.setattr(tokenfiles, "KEPT", 3)
    small = tokenfiles.PieceEncoder(tokenfiles.VOCABULARY)
    assert [x for i in range(0, len(texts), 7) for x in small.encode_all(texts[i : i + 7])] == want


def test_words_are_looked_up_as_arrays(monkeypatch):
    """Only new words are learned; long ones and those met longest ago go, those met again stay."""
    monkeypatch.setattr(tokenfiles, "KEPT", 3)
    kept, learned = tokenfiles.Words(), []

    def learn(words):
        learned.append(words)
        sizes = np.array([tokenfiles.ODD if w == "odd" else len(w) for w in words], np.int64)
        return sizes, np.array([ord(c) for w in words if w != "odd" for c in w], "<u4")

    def ids(word):
        (at,) = kept.places(pa.array([word], pa.large_string()), learn)
        size = int(kept.sizes[at])
        return "odd" if size == tokenfiles.ODD else "".join(map(chr, kept.ids[kept.starts[at] : kept.starts[at] + size]))

    def seen(words):
        for word in words:
            assert ids(word) == word
            kept.trim()
            assert len(kept.words) == len(kept.starts) == len(kept.sizes) == len(kept.met) <= 6
            assert len(kept.ids) == sum(max(n, 0) for n in kept.sizes.tolist())

    seen(["a", "bb", "x" * 65, "odd", "a", "ccc", "dd", "a", "e", "ff", "a", "bb", "x" * 65, "odd"])
    assert learned == [[w] if w else [] for w in ["a", "bb", "x" * 65, "odd", "", "ccc", "dd", "", "e", "ff", "", "bb", "x" * 65, "odd"]]
    several = pa.array(["new", "y" * 70, "a", "z"], pa.large_string())
    at = kept.places(several, learn)
    assert learned[-1] == ["new", "z", "y" * 70] and kept.words.take(pa.array(at)).to_pylist() == several.to_pylist()


@pytest.mark.parametrize("high", [200, 50_000, 2**32 - 1])
def test_file_format(tmp_path, high):
    draw = np.random.default_rng(high)
    ids = draw.integers(0, high, 5000, endpoint=True).astype("<u4")
    ends = np.array([0, 10, 10, 4096, 5000])
    path = tmp_path / "one.dac"
    path.write_bytes(tokenfiles.pack([None, 3, 4, -7, 2**40], ids, ends))
    with tokenfiles.TokenFile(str(path)) as file:
        assert file.documents()[0] == [None, 3, 4, -7, 2**40] and file.documents()[1].tolist() == ends.tolist()
        assert file.ids(0, 5000).tolist() == ids.tolist()
        for at in [0, 1, 511, 512, 513, 4999, *draw.integers(0, 5000, 50).tolist()]:
            assert file.token(at) == ids[at]
        assert file.ids(700, 1300).tolist() == ids[700:1300].tolist() and file.ids(9, 9).tolist() == []


def test_files(spark, sf_dir, nasty, nothing, tmp_path):
    library = Tokenizer.from_file(tokenfiles.VOCABULARY)
    for n, docs in enumerate((nasty, spark.read.parquet(f"{sf_dir}/documents.parquet"))):
        files = tokenfiles.write_files(docs, str(tmp_path / str(n)), file_ids=5000)
        got = sorted(tokenfiles.read_files(files, block=700).collect(), key=lambda r: r.start)
        order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
        assert order == sorted(order) and len(got) == docs.count()
        at = 0
        for r in got:
            assert r.start == at
            at += r.n_tokens
        want = []
        for r in docs.collect():
            ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
        assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    assert tokenfiles.read_files(tokenfiles.write_files(nothing, str(tmp_path / "none"))).collect() == []
