import random
import re

import numpy as np
import pytest

from urbanloom.llm import graph, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, percent):
    low = {i: i + 32 for i in range(65, 91)}
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("k", [4, 5])
def test_equals_brute_force(spark, k):
    rng = random.Random(k)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(rng.choice([1, 4, 25])):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"W{rng.randrange(400)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(900, ""), (901, None), (902, "one"), (903, "ONE"), (904, " \n\t")]
    rng.shuffle(rows)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=k).collect()
    want = brute(rows, k, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_null_ids_repeated_rows_and_extra_columns(spark):
    rows = [(5, "a b c d e f", "x"), (5, "a b c d e f", "x"), (None, "a b c d e f", "y"), (None, "z z z z z", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = minhash.near_duplicates(df).collect()
    assert sorted((r.doc_id is None, r.component_id is None, r.kept) for r in out) == [(False, False, True), (False, False, True), (True, False, True), (True, True, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_signature_is_two_permutations_shifted():
    hashes = np.unique(np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64))
    table, at = minhash._circle(minhash.BANDS * minhash.ROWS), (minhash.K.mix(hashes, 3) >> np.uint64(64 - minhash.CIRCLE_BITS)).astype(np.int64)
    sig = minhash.signature(hashes)
    assert sig[7] == table[at, 7].min() and len(sig) == minhash.BANDS * minhash.ROWS


def test_block_links_connect_what_is_similar():
    sets = [np.arange(0, 100), np.arange(5, 105), np.arange(10, 110), np.arange(1000, 1100), np.arange(1001, 1100)]
    got = minhash.block_links([(i, i, s.astype(np.uint64)) for i, s in enumerate(sets)], 80)
    assert len(got) == 3 and {frozenset(x) for x in got} >= {frozenset((3, 4))}


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    out = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_different_texts_never_share_a_class(spark, n):
    df = spark.createDataFrame(list(enumerate(thue_morse(n), 1)), "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()) == [(1, 1, True), (2, 2, True)]


def test_near_copies_without_ids_are_linked(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(7, " ".join(base)), (None, " ".join([*base[:299], "x"])), (3, " ".join(["y", *base[1:]])), (None, "alone in the world"), (9, "")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.n_shingles) for r in out) == [("3", "3", 296), ("7", "3", 296), ("9", "9", 0), ("None", "3", 296), ("None", "None", 1)]


def test_one_class_and_one_component_with_most_rows(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base)) for i in range(100, 160)] + [(i, " ".join([*base[: i % 200], f"v{i}", *base[i % 200 + 1 :]])) for i in range(200, 260)] + [(i, f"other {i}") for i in range(20)]
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {**{i: 100 for i in [*range(100, 160), *range(200, 260)]}, **{i: i for i in range(20)}}
