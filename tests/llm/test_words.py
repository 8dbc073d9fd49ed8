import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from factloom.llm.words import Scanner

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbBéÉ \t\n\x0b.,漢", max_size=40)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_ngrams_equal_plain_splitting(texts):
    known, seen = {}, 0
    for piece in Scanner().pieces(pa.array(texts, pa.string())):
        for row in range(len(piece)):
            words = (texts[piece.first + row] or "").encode().lower().split()
            own = piece.hashes[piece.rows[row]: piece.rows[row + 1]]
            assert len(own) == len(words)
            for word, h in zip(words, own):
                assert known.setdefault(word, h) == h
        for row, grams in piece.sequences(3):
            words = (texts[piece.first + row] or "").encode().lower().split()
            want = {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
            assert len(grams) == len(want) and (np.diff(grams.astype(object)) > 0).all()
            seen += 1
    assert len(set(known.values())) == len(known) and seen == len(texts)


def test_slices_and_long_texts():
    texts = pa.array(["no", "y" * 3_000_000, "a b", None, "a b c"], pa.string())[1:]
    rows = [p.first + r for p in Scanner().pieces(texts) for r in range(len(p))]
    assert rows == [0, 1, 2, 3]
    assert [len(p.hashes) for p in Scanner().pieces(texts)] == [1, 5]


def test_letters_only_parts_at_punctuation():
    piece = next(Scanner(True).pieces(pa.array(["Scum, scum. SCUM!! é"])))
    assert len(set(piece.hashes)) == 2 and len(piece.hashes) == 4
