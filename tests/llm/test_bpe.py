import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from countweave.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.vocabulary()), reason="no vocabulary")


@pytest.fixture(scope="module")
def pair():
    import tiktoken

    e = bpe.Encoder(bpe.vocabulary())
    return e, tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=e.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    e, t = test_any_text.pair
    ids = e.encode(text)
    assert ids == t.encode_ordinary(text) and b"".join(test_any_text.bytes[i] for i in ids).decode() == text


@pytest.fixture(autouse=True)
def _keep(pair):
    test_any_text.pair = pair
    test_any_text.bytes = {v: k for k, v in pair[0].ranks.items()}


def test_long_pieces_and_special_strings(pair):
    e, t = pair
    r = random.Random(0)
    for s in ("<|endoftext|> x", "a" * 5000, "".join(r.choice("abcdefüß") for _ in range(20_000)), " " * 999 + "x", "🚴‍♀️" * 50):
        assert e.encode(s) == t.encode_ordinary(s)


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "Hallo Velo"), (4, "x " * 30_000), (5, "Hallo Velo")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS ids")
    got = {r["doc_id"]: r["ids"] for r in bpe.encoded(df, "doc_id", "text").collect()}
    assert got[1] == got[2] == [] and got[3] == got[5] and len(got[4]) > 20_000
    n = {r["doc_id"]: r["n_tokens"] for r in bpe.token_counts(df, ["doc_id"], "text").collect()}
    assert n == {k: len(v) for k, v in got.items()}
    assert bpe.encoded(df.limit(0), "doc_id", "text").count() == 0


def test_ranks_are_those_of_the_file():
    with open(bpe.vocabulary(), "rb") as f:
        a, b = f.readline().split()
    assert bpe.Encoder(bpe.vocabulary()).ranks[base64.b64decode(a)] == int(b)
