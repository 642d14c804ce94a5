import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ridertide.llm.tokens import Pieces, pieces

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PARTS = ["word", "Word", " ", "  ", "\n", "\t", "'s", "'", "é", "ÀÉ", "×", "÷", "日本", "12", ".", "!?", "<|endoftext|>", "<|StartOfText|>", "<|", "endoftext|>", "　", "́", "\x85", "ß", "_", "|", "İ"]


def direct(file):
    return Tokenizer.from_file(public_tokenizers.path(file))


@pytest.mark.parametrize("file", FILES)
@settings(deadline=None, max_examples=150)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=6))
def test_same_as_whole_texts(file, texts):
    ids, bounds = pieces(file).encode(pa.array([*texts, None], pa.string()), 7)
    whole = direct(file)
    got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [[*whole.encode(t, add_special_tokens=False).ids, 7] for t in [*texts, ""]]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr("ridertide.llm.tokens.MOST_PIECES", 3)
    encoder = Pieces(FILES[0])
    texts = pa.array(["a b c d e f", "g h i j", "a b c"])
    first = encoder.encode(texts, 0)[0].tolist()
    assert encoder.encode(texts, 0)[0].tolist() == first
    assert len(encoder.known) <= 10
