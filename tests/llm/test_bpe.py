import base64
import random
from array import array

import pytest

from urbanloom.llm import bpe
from urbanloom.llm.queries import vocabulary

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    raw, pattern = vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return bpe.Codec(raw, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ids(codec, text):
    return list(array("i", codec.encode(text)))


def test_equals_tiktoken(both):
    codec, enc = both
    rng = random.Random(3)
    texts = ["", " ", "a", "Hello world!!  \n\n x", "<|endoftext|>", "éàü ß 漢字 🙂🙂", "a" * 3000, "ab" * 500, "\r\n\t \x1c\x85", "don't we'LL", "1234567 89"]
    texts += ["".join(rng.choice("abcde fgh.\n'é漢1") for _ in range(rng.randrange(200))) for _ in range(150)]
    texts += ["".join(rng.choice("ab") for _ in range(400)) for _ in range(10)]
    for t in texts:
        assert ids(codec, t) == enc.encode_ordinary(t)
        assert codec.decode(array("i", codec.encode(t))) == t.encode()


def test_dataframe_cases(spark, both):
    rows = [(1, "one two", "x"), (None, None, None), (2, "", "y"), (1, "one two", "x"), (3, "long " * 5000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.digests(bpe.encode_decode(df, *vocabulary())).collect()
    assert len(out) == 5 and sorted(r.n_tokens for r in out)[:2] == [0, 0]
    assert {r.n_tokens for r in out if r.doc_id == 1} == {len(both[1].encode_ordinary("one two"))}
    assert bpe.encode_decode(df.limit(0), *vocabulary()).count() == 0
