"""What the encoder of operator 6 asks the library for."""
import pyarrow as pa
from tokenizers import Tokenizer

from sheenwake.llm import token_files


def _asked(monkeypatch, own):
    """Words and marks given to the library from here on."""
    asked, library = [], own.library
    monkeypatch.setattr(own, "library", lambda texts: asked.extend(" ".join(texts).split()) or library(texts))
    return asked


def _check(own, texts):
    tok = Tokenizer.from_file(token_files.vocabulary())
    flat, sizes = own.encode(pa.array(texts))
    want = [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


def test_marks_behind_letters_are_not_asked_for_again(monkeypatch):
    own = token_files.Encoder(token_files.vocabulary())
    asked = _asked(monkeypatch, own)
    _check(own, ["zebra zebra, zebra. zebra?!\"\nzebra,\nzebra Œuvre&&& a"])
    assert sorted(asked) == sorted(["zebra", "zebra", "Œuvre", ",", ".", "?!\"", "&&&", "a"])  # one behind a line feed
    odd = ["don't' can'", "a,b, ab;'s x!'s", "x1, 1, ,,, a,,,, a....", "a×, ÷. ªb, ŉ,", "\n,a \n, b,\n", "a,\x1c b,", "<|endoftext|>, a<|"]
    for t in odd:
        _check(own, [t])
        _check(own, [t])
    _check(own, odd)


def test_frequent_words_outlast_a_full_table(monkeypatch):
    own = token_files.Encoder(token_files.vocabulary())
    monkeypatch.setattr(token_files, "KEPT_WORDS", 20)
    _check(own, ["common words, here"])
    _check(own, ["common words, here \x02odd"])
    asked = _asked(monkeypatch, own)
    for k in range(6):
        _check(own, ["common words, " + " ".join(f"rare{k}x{i}" for i in range(9))])
    assert len(own.number) < 60 and not {"common", "words", "words,"} & set(asked)
