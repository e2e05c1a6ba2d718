import random
import re

from urbanloom.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def brute(docs, items, w=10):
    windows = {}
    for k, t in items:
        if k is None or t is None:
            continue
        words = WORD.findall(t.translate(LOW))
        n = min(w, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(str(k))
    out = {}
    for d, t in docs:
        words, hit, keys = WORD.findall((t or "").translate(LOW)), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(words) - size + 1):
                if (own := windows.get(tuple(words[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    keys |= own
        out[d] = (len(words), len(hit), sorted(keys))
    return out


def cases():
    rng = random.Random(2)
    word = lambda: rng.choice(["alpha", "Beta", "é1", "x"]) + str(rng.randrange(30))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 10, 25])))) for i in range(12)] + [(90, ""), (91, None), (None, "alpha1"), (92, "!!!"), (11, "same id twice here")]
    docs = []
    for d in range(40):
        text = [word() for _ in range(rng.randrange(40))]
        if d % 2:
            src = (items[rng.randrange(12)][1]).split()
            a = rng.randrange(len(src))
            text[5:5] = src[a : a + rng.randrange(1, 25)]
        docs.append((d, rng.choice([" ", ", ", "\n-- "]).join(text)))
    return [*docs, (100, None), (101, ""), (102, "SAME id-Twice\there")], items


def check(spark):
    docs, items = cases()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = decontam.contamination(df.selectExpr("*", "1 AS hits"), bench.selectExpr("*", "2 AS k", "3 AS t"))
    rows = out.collect()
    want = brute(docs, items)
    assert {r.doc_id: (r.n_words, sum(h.b - h.a for h in r["hits"]), r["items"]) for r in rows} == want
    text = dict(docs)
    for r in rows:  # offsets point into the original
        for h, s in zip(r["hits"], r["spans"]):
            assert len(WORD.findall(text[r.doc_id][s.a : s.b].translate(LOW))) == h.b - h.a
    assert decontam.verdicts(out).where("contaminated <> (n_hit > 0)").count() == 0
    assert decontam.contamination(df.limit(0), bench).count() == 0
    assert decontam.verdicts(decontam.contamination(df, bench.limit(0))).where("contaminated").count() == 0


def test_equals_brute_force(spark):
    check(spark)


def test_several_parts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "AUTOMATON_BYTES", 600)
    check(spark)


def test_several_parts_keep_rows_of_null_and_repeated_ids(spark, monkeypatch):
    leak, clean = "p1 p2 p3 p4 q1 q2 q3 q4", "c1 c2 c3 c4 c5 c6 c7 c8"
    docs = [(None, leak), (None, clean), (None, clean), (7, leak), (7, clean), (7, clean), (8, None), (8, "")]
    items = [(i, f"{a}1 {a}2 {a}3 {a}4") for i, a in enumerate("pqrstuvw")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for carry in ((), ("text",)):
        want = sorted(map(str, decontam.contamination(df, bench, carry=carry).collect()))
        assert len(want) == len(docs) and sum("items=['0', '1']" in r for r in want) == 2
        monkeypatch.setattr(decontam, "AUTOMATON_BYTES", 20)
        assert sorted(map(str, decontam.contamination(df, bench, carry=carry).collect())) == want
        monkeypatch.undo()
