import random

import numpy as np
import public_tokenizers
import pytest

from codexflow.llm.encoding import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", "a", " a", "a ", " ", "  ", "a  b", "a\nb", "a\n\nb", "a \n b", "\n", "it's", "don't 'tis", "x²y ½", "été ÷ × où", "a b",
    "日本語 テスト", "a.b,c", "...", "<|endoftext|> a", "a\tb", "\x1ca b", "a\r\nb", "ß'S 'll 12ab ab12", "naïvé x", "word\n\n", "\nword x", "a.'s b", "x" * 3000,
]


def test_odd_texts_equal_the_library():
    enc = encoder(PATH)
    for text, ids in zip(ODD, enc.batch(ODD), strict=True):
        assert ids.tolist() == (enc.whole(text) if text else []), text


def test_random_texts_equal_the_library():
    enc, rng = encoder(PATH), random.Random(4)
    for alphabet in ("ab é.,'\n\t 1² !s?日 \r", "the of in. ,\n"):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
        for text, ids in zip(texts, enc.batch(texts), strict=True):
            assert ids.tolist() == enc.whole(text), repr(text)


def test_long_text_in_segments_and_a_full_table():
    enc, rng = encoder(PATH, 12), random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(8000)]
    text = " ".join(rng.choice(words) for _ in range(300_000))
    assert len(text) > 1 << 20
    assert np.array_equal(enc.batch([text, "a b"])[0], np.array(enc.whole(text), np.uint32))
    assert np.array_equal(enc.batch([text])[0], np.array(enc.whole(text), np.uint32))


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_encode_whole_texts(name):
    enc = encoder(public_tokenizers.path(name))
    assert not enc.by_piece
    assert enc.batch(["Hello there"])[0].tolist() == enc.whole("Hello there")
