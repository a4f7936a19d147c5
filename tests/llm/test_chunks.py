"""The short way of the encoder: printable ASCII chunks are told apart without a pattern."""

from inkwell.llm import bpe


def test_ascii_chunks_are_split_as_before(monkeypatch):
    own = bpe.encoder(bpe.VOCABULARY)
    asked = []
    words = bpe._ASCII_WORDS
    monkeypatch.setattr(bpe, "_ASCII_WORDS", type("Seen", (), {"findall": lambda self, text: asked.append(text) or words.findall(text)})())
    chunks = ["", "Stone", "it's", "a1b", "x--y", "7", "\x7fa", "a\x01", "q~!"]
    for chunk in chunks:
        normal = own.library.normalizer.normalize_str(chunk)
        assert own._words(chunk) == [w for w, _ in own.library.pre_tokenizer.pre_tokenize_str(normal)], chunk
    assert "stone" not in asked and "it's" in asked
