import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from urbanloom.llm import suffix


def brute(texts, w):
    count = Counter(t[s : s + w] for t in texts for s in range(len(t) - w + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t), bool)
        for s in range(len(t) - w + 1):
            if count[t[s : s + w]] > 1:
                hit[s : s + w] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(int), [0]])))
        out.append((len(t), int(hit.sum()), len(edge) // 2, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~hit])).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "abé" if seed % 2 else "abcdefghij"
    parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 120))) for _ in range(6)]
    texts = ["".join(rng.choice([rng.choice(parts), "".join(rng.choice(letters) for _ in range(rng.randrange(30)))]) for _ in range(rng.randrange(1, 6))) for _ in range(25)]
    return [*texts, texts[0], texts[3], "", "a" * 300, "xa" * 100, "line one of text\n" * 12, "b" + "a" * 45, "é" * 60]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("split, group", [(256, 50_000), (1, 50_000), (1, 1)])
def test_equals_brute_force(spark, seed, split, group):
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digests(suffix.remove_repeats(df, window=40, gram=10, split=split, group=group)).collect()}
    want = brute([t.encode() for t in texts], 40)
    assert [got[i] for i in range(len(texts))] == want


def test_nulls_repeated_rows_and_remaining(spark):
    rows = [(1, "q" * 10 + "0123456789" * 5, "x"), (1, "q" * 10 + "0123456789" * 5, "x"), (None, None, None), (None, "0123456789" * 5 + "tail", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = suffix.digests(suffix.remove_repeats(df, window=40, gram=10)).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in out) == [(0, 0), (54, 50), (60, 60), (60, 60)]
    assert sorted(bytes(r.kept) for r in suffix.remaining(df, window=40, gram=10).collect()) == [b"", b"", b"", b"tail"]
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_plain_comparison_agrees():
    rng = random.Random(5)
    raw = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(5, 20))) + b"ANCHOR" + bytes(rng.choice(b"ab") for _ in range(rng.randrange(5, 20))) for _ in range(40)]
    data, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
    ends = np.cumsum(sizes)
    starts, places = ends - sizes, ends - sizes + np.array([r.index(b"ANCHOR") for r in raw])
    l, r = suffix.repeats(np.zeros(40, np.int64), data, starts, places, ends, 16)
    pl, pr = np.zeros(40, np.int64), np.zeros(40, np.int64)
    suffix._plainly(np.arange(40), data.tobytes(), starts, places, ends, 16, pl, pr)
    assert (l == pl).all() and (r == pr).all() and (r > 0).any()
    order = suffix.Extensions(data, starts, places, ends).sort(np.zeros(40, np.int64), True)
    tails = [raw[i][raw[i].index(b"ANCHOR") :] for i in order]
    assert tails == sorted(tails)


def test_passages_that_repeat_across_documents_go_and_clean_ones_stay(spark):
    # passages of over 50 words, 400 bytes and more, each in several documents; shorter ones must stay
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(5, 12)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(4)] + [" ".join(word() for _ in range(8))]
    assert all(len(p) >= 400 for p in passage[:4]) and len(passage[4]) < 400
    own = lambda: " ".join(word() for _ in range(rng.randrange(5, 60)))
    rows, held = [], {}
    for i in range(60):
        inside = [passage[rng.randrange(5)]] if i % 2 else []
        rows.append((i, " ".join([own(), *inside, own()])))
        held[i] = [p for p in inside if len(p) >= 400]
    found = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        text = dict(rows)[r.doc_id].encode()
        for p in held[r.doc_id]:
            at = text.index(p.encode())
            assert any(s.a <= at and at + len(p) <= s.b for s in r.spans)
        if not held[r.doc_id]:
            assert not r.spans
    assert sum(bool(r.spans) for r in found) == sum(map(bool, held.values()))


def test_long_texts_are_read_in_slices(monkeypatch):
    rng = random.Random(4)
    raw = bytes(rng.choice(b"abcd") for _ in range(3000)) + b"x" * 500 + bytes(rng.choice(b"ab") for _ in range(700))
    data, offs = np.frombuffer(raw, np.uint8), np.array([0, 900, 900, 930, len(raw)])
    whole = suffix.anchors(data, offs, 40, 10)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(suffix, "SLICE", size)
        assert all(np.array_equal(a, b) for a, b in zip(whole, suffix.anchors(data, offs, 40, 10)))
