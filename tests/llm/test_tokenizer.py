import base64
import os

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm.tokenizer import DEFAULT_RANKS, PATTERN, Encoder, count_tokens, encode_texts, merge, read_vocabulary

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_RANKS), reason="no vocabulary files")
ODD = ["", " ", "\n", "a\n\n  b \n", "\r\n\t x", "it's we'll I'd", "x" * 5000, "    " * 500 + "a", "naïve café ＡＢＣ", "日本語 テスト", "😀👩‍👩‍👧 x", "<|endoftext|> a", "\x1c a\x85b\xa0c d", "1234 56.78e-9", "\ud83d"]


@pytest.fixture(scope="module")
def ours():
    return Encoder(read_vocabulary(DEFAULT_RANKS))


@pytest.fixture(scope="module")
def theirs():
    tiktoken = pytest.importorskip("tiktoken")
    with open(DEFAULT_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(enc, text):
    return np.frombuffer(enc.encode(text), np.int32).tolist()


@pytest.mark.parametrize("text", ODD[:-1])
def test_odd_texts(ours, theirs, text):
    assert ids(ours, text) == theirs.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("  \n\t'aeisx0.,{}")), max_size=120))
def test_property(ours, theirs, text):
    assert ids(ours, text) == theirs.encode_ordinary(text)
    assert ids(ours, text) == theirs.encode_ordinary(text)  # from the caches


def test_merge_takes_the_leftmost_of_equal_ranks():
    assert merge([1, 1, 1], {1 << 16 | 1: 2}) == [2, 1]
    assert merge([1, 1, 1, 1], {1 << 16 | 1: 2, 2 << 16 | 2: 3}) == [3]
    assert merge([], {}) == [] and merge([5], {}) == [5] and merge([5, 6], {}) == [5, 6]


def test_long_words(ours, theirs):
    rng = np.random.default_rng(1)
    word = "".join(rng.choice(list("abcdefg"), 60_000))
    assert ids(ours, word) == theirs.encode_ordinary(word)


def test_small_caches_change_nothing(theirs, monkeypatch):
    import tessera.llm.tokenizer as t

    monkeypatch.setattr(t, "CACHED", 3)
    small = Encoder(read_vocabulary(DEFAULT_RANKS))
    for text in [*ODD[:-1], "a b c d e\nf g\nh i j k", "a b c d e\nf g\nh i j k"]:
        assert ids(small, text) == theirs.encode_ordinary(text)


def test_tables(spark, theirs):
    texts = [*ODD[:-1], None, "same", "same"]
    df = spark.createDataFrame([(i, t, [0], "x") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, out string")
    got = {r.doc_id: r.ids for r in encode_texts(df, "text", ["doc_id"]).collect()}
    assert got == {i: theirs.encode_ordinary(t or "") for i, t in enumerate(texts)}
    n = {r.doc_id: r.n_tokens for r in count_tokens(df, "text", ["doc_id"]).collect()}
    assert n == {i: len(x) for i, x in got.items()}
    assert encode_texts(df.limit(0), "text", ["doc_id"]).count() == 0


def test_round_trip(ours, theirs):
    text = "def f(x):\n    return [y ** 2 for y in x]  # é 漢\n"
    assert theirs.decode(ids(ours, text)) == text


def test_vocabularies_that_cannot_work_are_refused():
    line = lambda b, i: base64.b64encode(b) + f" {i}\n".encode()
    whole = b"".join(line(bytes([i]), i) for i in range(256))
    assert ids(Encoder(whole), "ab") == [97, 98]
    with pytest.raises(ValueError, match="65536"):
        Encoder(whole + line(b"ab", 65536))
    with pytest.raises(ValueError, match="lacks"):
        Encoder(whole.split(b"\n", 1)[1])
