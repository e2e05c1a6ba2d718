import os
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from urbanloom.llm import kernels as K
from urbanloom.llm import quality, toxicity
from urbanloom.llm.training import held_out, sample

SF = "/root/testdata/sf0.1"


def held(rows, label):
    out = [(r.score, r[label], r.held_out) for r in rows]
    y, p = np.array([o[1] for o in out if o[2]]), np.array([o[0] for o in out if o[2]])
    return y, p


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    y, p = held(quality.quality(docs, labels).join(labels, "doc_id").collect(), "quality")
    assert len(y) > 500 and ((p >= 0.7) == y).mean() > 0.97
    y, p = held(toxicity.toxicity(docs, labels).join(labels, "doc_id").collect(), "toxic")
    assert ((p >= 0.5) == y).mean() > 0.97


def test_held_out_rows_and_labels_stay_unseen(spark):
    ids = spark.range(200).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.h for r in ids.select("doc_id", held_out("doc_id", 4, 2).alias("h")).collect()}
    assert got == {i: crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def test_sparse_scores_do_not_depend_on_chunks():
    rng = np.random.default_rng(0)
    texts = ["", "x"] + [" ".join(rng.choice(["good", "BAD!!", "so-so", "é", "12"], 40)) for _ in range(60)]
    w = quality.train(pa.array(texts), np.array([len(t) % 2 for t in texts]))
    whole = np.concatenate([quality.score(d, o, w) for _, d, o in K.chunks(pa.array(texts))])
    parts = np.concatenate([quality.score(d, o, w) for _, d, o in K.chunks(pa.array(texts), 10)])
    assert np.allclose(whole, parts) and ((0 <= whole) & (whole <= 1)).all()


def subsequences(s, t, lam, n=3):
    from itertools import combinations

    total = 0.0
    for a in combinations(range(len(s)), n):
        for b in combinations(range(len(t)), n):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += lam ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_equals_its_definition():
    words = [b"idiot", b"idxiot", b"moron", b"aabba", b"xyz"]
    x = toxicity.rows_of(words)
    got = toxicity._raw(x, x)
    want = [[subsequences(a, b, toxicity.DECAY) for b in words] for a in words]
    assert np.allclose(got, want, rtol=1e-4)
    norm = toxicity.kernel(x, x)
    assert np.allclose(np.diag(norm), 1, atol=1e-4) and norm[0, 1] > 0.4 > norm[0, 2]


def test_gapped_insults_and_edge_cases(spark):
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("aelnrsu"), 5)) for _ in range(300)]
    clean = [" ".join(rng.choice(plain, 40)) for _ in range(200)]
    toxic = [c + ". " + " ".join(f"You {w}." for w in rng.choice(["blockhead", "dimwit", "wretch"], 3)) for c in clean[:60]]
    model = toxicity.train(pa.array(clean + toxic), np.array([0] * 200 + [1] * 60))

    def p(t):
        return float(model.probability(model.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), {}))[0])

    assert p(clean[100]) < 0.1 and p("you d i m w i t there") > 0.5 and p("what a block-head") > 0.5
    assert p("blocxkhead") > p(clean[101]) + 0.1 and p("") < 0.1
    df = spark.createDataFrame([(1, "dimwit", 1.0), (None, None, 0.0), (1, "dimwit", 1.0)], "doc_id long, text string, score double")
    out = toxicity.classify(df, model).collect()
    assert len(out) == 3 and sum(r.score > 0.5 for r in out) == 2
    assert toxicity.classify(df.limit(0), model).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.toxicity(df, nothing).where("score between 0 and 1").count() == 3
    assert quality.quality(df, nothing).where("score = 0.5").count() == 3


def weights_of(word, lam, n=3):
    from itertools import combinations

    out = {}
    for a in combinations(range(len(word)), n):
        key = tuple(word[i] for i in a)
        out[key] = out.get(key, 0.0) + lam ** (a[-1] - a[0] + 1)
    return out


def test_toxicity_equals_brute_force():
    rng = np.random.default_rng(8)
    plain = ["".join(rng.choice(list("aelnrsu"), 5)) for _ in range(80)]
    clean = [" ".join(rng.choice(plain, 30)) for _ in range(80)]
    toxic = [c + ". " + " ".join(f"You {w}." for w in rng.choice(["blockhead", "dimwit"], 3)) for c in clean[:30]]
    model = toxicity.train(pa.array(clean + toxic), np.array([0] * 80 + [1] * 30))
    marks = [weights_of(bytes(r[r > 0]), toxicity.DECAY) for r in model.rows]
    norm = [sum(v * v for v in m.values()) ** 0.5 for m in marks]

    def value(word):
        own = weights_of(word, toxicity.DECAY)
        size = sum(v * v for v in own.values()) ** 0.5
        if not size:
            return toxicity.FLOOR
        dots = [sum(v * m.get(k, 0.0) for k, v in own.items()) / (size * n) if n else 0.0 for m, n in zip(marks, norm)]
        return max(float(np.dot(dots, model.beta)) + model.bias, toxicity.FLOOR)

    def score(text):
        words = [w for w in ("".join(c for c in x.lower() if c.isalnum()).encode() for x in (text or "").split()) if w]
        values = sorted((value(w) for w in words), reverse=True)
        top = [min(max(v, -0.5), 1.5) if v > toxicity.FLOOR else -0.5 for v in values[:3]]
        high = [sum(v > level for v in values) for level in toxicity.LEVELS]
        z = [*top, *[-0.5] * (3 - len(top)), *np.log1p(high), min(10 * high[1] / max(len(values), 20), 2)]
        return 1 / (1 + np.exp(-(np.dot(z, model.slope) + model.shift)))

    texts = [*clean[:20], *toxic[:20], "", "a", "ab no", "you DIM-WIT", "blxockhead " * 30, None]
    got = np.concatenate([model.probability(model.features(d, o, {})) for _, d, o in K.chunks(pa.array(texts, pa.string()))])
    assert np.allclose(got, [score(t) for t in texts], atol=2e-3)


def test_quality_equals_brute_force():
    """Training and scores against the plain recurrences of follow-the-regularised-leader, feature by feature."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["good", "BAD!!", "so-so", "é", "12", "Good good"], int(rng.integers(0, 30)))) for _ in range(40)] + [""]
    labels = rng.integers(0, 2, len(texts))
    alpha, beta, l1, l2 = 2.0, 0.01, 1e-4, 1e-6
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - (1 if zi > 0 else -1) * l1) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    def own(text):
        data = np.frombuffer(text.encode(), np.uint8)
        f, _, count = quality.features(data, np.array([0, len(data)]))
        x = {}
        for i in f.tolist():
            x[i] = x.get(i, 0) + 1 / count[0]
        return x

    for _ in range(quality.EPOCHS):
        for t, y in zip(texts, labels):
            x = own(t) | {1 << quality.BITS: 1.0}
            w = {i: weight(i) for i in x}
            g0 = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items()))) - y
            for i, v in x.items():
                g = g0 * v
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    want = [1 / (1 + np.exp(-(weight(1 << quality.BITS) + sum(weight(i) * v for i, v in own(t).items())))) for t in texts]
    trained = quality.train(pa.array(texts), labels)
    got = np.concatenate([quality.score(d, o, trained) for _, d, o in K.chunks(pa.array(texts))])
    assert np.allclose(got, want, atol=1e-4) and max(got) - min(got) > 0.1


def test_training_sample_is_bounded_in_rows_and_bytes(spark):
    rows = [(i % 50, "x" * (i % 50 + 1) + "y" * (i >= 50), 0.5) for i in range(100)] + [(None, "z", 0.1), (50, None, 0.2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _label double")
    labels = spark.createDataFrame([(i % 51, i % 2) for i in range(102)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    keep = ~held_out("doc_id", 5, 0)
    ids = [i for i in range(51) if crc32(str(i).encode()) % 5]
    got = {r.doc_id: (r["_text"], r["_label"]) for r in sample(df.drop("_label"), labels, "toxic", keep, 1000).collect()}
    assert got == {i: (None if i == 50 else "x" * (i + 1), 1) for i in ids}
    few = sample(df.drop("_label"), labels, "toxic", keep, 10).collect()
    assert len(few) == 10
    small = sample(df.drop("_label"), labels, "toxic", keep, 1000, most=200).collect()
    assert 0 < sum(len(r["_text"] or "") for r in small) <= 200 and {r.doc_id for r in small} < set(ids)


def test_very_long_texts(spark):
    long = "so-so Good words " * 60_000
    df = spark.createDataFrame([(1, long), (2, "x" * 1_000_000), (3, "short")], "doc_id long, text string")
    weights = quality.train(pa.array(["good words", "bad!!"]), np.array([1, 0]))
    assert quality.classify(df, weights).where("score between 0 and 1").count() == 3
    model = toxicity.train(pa.array(["nice day"] * 8 + ["you dimwit there"] * 8), np.array([0] * 8 + [1] * 8))
    assert toxicity.classify(df, model).where("score between 0 and 1").count() == 3
