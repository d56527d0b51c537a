import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import token_ids
from quillspark.llm.token_ids import encode, encode_corpus, encoding

ALPHABET = ["a", "b", " ", "  ", "\n", "'", "'s", "don't", "1", "23", "!", "é", "日", "😀", "the ", "ing", "̈", "²", "\t", "<|endoftext|>", "…", " "]


@given(st.lists(st.sampled_from(ALPHABET), max_size=120), st.integers(1, 23))
@settings(max_examples=300, deadline=None)
def test_halves_equal_the_whole(parts, leaf):
    enc, s = encoding(), "".join(parts)
    assert encode(enc, s, leaf) == enc.encode_ordinary(s)


@pytest.mark.parametrize("s", ["a" * 50_000, " " * 20_000 + "x", "ab" * 30_000, "\n" * 9_999, "日本語" * 5000, "'" * 5000 + "s"])
def test_long_unsplit_texts(s):
    enc = encoding()
    assert encode(enc, s, 4096) == enc.encode_ordinary(s)


def test_corpus(spark, wide):
    r = random.Random(1)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 300))) for _ in range(80)] + ["", None, " ", "x" * 3000, "one two " * 400]
    d = wide(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    enc = encoding()
    for spread in (1_000_000, 64):
        got = {x.doc_id: x.ids for x in encode_corpus(d, spread_chars=spread).collect()}
        assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    counts = {x.doc_id: x.n_tokens for x in encode_corpus(d, count_only=True, spread_chars=64).collect()}
    assert counts == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert encode_corpus(d.limit(0)).count() == 0


def test_equals_the_other_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    s = "It's plain <|endoftext|> text,  zwei Wörter\n\nund 日本語 1234."
    assert t.encode(s, add_special_tokens=False).ids == encoding().encode_ordinary(s)


def test_windows_stay_small_in_unsplit_text():
    import random

    enc, r = token_ids.encoding(), random.Random(5)
    letters = {"cjk": range(0x4E00, 0x9000), "cyrillic": range(0x430, 0x450), "digits": range(0x30, 0x3A), "rules": [ord("=")], "signs": [ord(c) for c in "-+*/'#'"], "mixed": [ord(c) for c in "aZ'sé1٣²一-_\u0301"]}
    for name, codes in letters.items():
        text = "".join(chr(r.choice(codes)) for _ in range(20_000))
        seen = []

        class Counted:
            decode_bytes = enc.decode_bytes

            def encode_ordinary(self, t):
                seen.append(len(t))
                return enc.encode_ordinary(t)

        assert token_ids.encode(Counted(), text, 512) == enc.encode_ordinary(text), name
        # one sign repeated shifts what lies behind a join: as many passes as the tree has levels at most
        assert sum(seen) / len(text) < (4 if name == "rules" else 1.5), (name, sum(seen) / len(text))
