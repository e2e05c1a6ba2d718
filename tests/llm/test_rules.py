import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from urbanloom.llm import kernels as K
from urbanloom.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_counts_equal_brute_force():
    rng = random.Random(8)
    bits = ["a", "bb", "é漢", "#", " ", " ", "\n", "\n\n", "\t", "one two three four five six ", "same line\n", " ", "|x|"]
    texts = ["", " ", "\n"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(400)]
    got = np.concatenate([rules.measure(d, o) for _, d, o in K.chunks(pa.array(texts), 500)], axis=1)
    assert [tuple(c[:5]) for c in got.T.tolist()] == [brute(t) for t in texts]


def test_upper_bound_is_exact():
    assert abs(rules.upper_bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9
    assert rules.upper_bound(5, 5, 0.05) == 1.0 and rules.upper_bound(0, 0, 0.05) == 1.0
    assert abs(rules.upper_bound(3, 50, 0.025) - 0.1655) < 1e-3


def test_calibration_limits_false_rejections():
    rng = random.Random(1)
    k = len(rules.RULES)
    rows = [("en", True, *[rng.random() * 0.04 for _ in range(k)]) for _ in range(3000)] + [("en", False, *[rng.random() for _ in range(k)]) for _ in range(300)] + [("xx", False, *[1.0] * k)] * 5
    cut = rules.calibrate(rows)
    assert "xx" not in cut and set(cut["en"]) == {r[0] for r in rules.RULES}
    assert all(sum(r[2 + j] > cut["en"][n] for r in rows if r[1]) / 3000 <= rules.RISK for j, (n, _, _) in enumerate(rules.RULES))


def test_dataframe_cases(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, "en", 7), (None, None, None, 7), (2, "", "en", 7), (1, words, "en", 7), (3, "a b c d e " * 6, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    out = rules.verdicts(df, labels).collect()
    assert sorted((r.n_words, r.base_failed, r.kept) for r in out) == [(0, True, False), (0, True, False), (30, False, True), (30, False, True), (30, True, False)]
    assert rules.verdicts(df.limit(0), labels.limit(0)).count() == 0


def test_calibration_reads_all_labelled_rows(spark):
    # a rare stratum has enough good rows for a cutoff only if no labelled row is left out
    good, bad = " ".join(f"w{i}" for i in range(12)), " ".join(f"w{i}#" for i in range(12))
    kind = "CASE WHEN id < 11000 THEN 'en' ELSE 'es' END AS lang"
    df = spark.range(12300).selectExpr("id AS doc_id", f"CASE WHEN id < 12200 THEN '{good}' ELSE '{bad}' END AS text", kind)
    out = rules.verdicts(df, spark.range(12300).selectExpr("id AS doc_id", "CAST(id < 12200 AS INT) AS quality"))
    assert {(r.kept, r["count"]) for r in out.groupBy("kept").count().collect()} == {(True, 12200), (False, 100)}


def test_upper_bound_of_many_rows():
    assert abs(rules.upper_bound(400_000, 100_000_000, 0.05) - 0.00401) < 1e-5


def test_lines_and_words_that_only_hash_alike_are_told_apart():
    s = "a"
    while len(s) < 4096:
        s += s.translate(str.maketrans("ab", "ba"))
    t = s.translate(str.maketrans("ab", "ba"))
    for text in (f"{s}\n{t}", f"{s}\n{t}\n{s}", " ".join([s, t, "c", "d", "e", t, s, "c", "d", "e"])):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert tuple(rules.measure(raw, np.array([0, len(raw)]))[:5, 0].tolist()) == brute(text)


def test_equal_hashes_are_resolved_by_bytes(monkeypatch):
    monkeypatch.setattr(K, "span_hash", lambda data, a, b: (b - a).astype(np.uint64))
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "d"]) for _ in range(40)) + "\nab\nba\nab" for _ in range(20)]
    got = np.concatenate([rules.measure(d, o) for _, d, o in K.chunks(pa.array(texts))], axis=1)
    assert [tuple(c[:5]) for c in got.T.tolist()] == [brute(t) for t in texts]
