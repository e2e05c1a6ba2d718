import random
import re
import string

from urbanloom.llm import secrets

A = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(t):
    out = [(m.start(), 0, m.end()) for m in A.finditer(t) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 24])


def brute(rows, rate=secrets.FDR):
    """Spans of each text, the battery's by weighted Benjamini-Hochberg over the distinct candidates of all texts."""
    own = {t[a:b]: (b - a, p) for t in rows for a, b, p in secrets.find(t)[1]}
    mean = sum(n for n, _ in own.values()) / max(len(own), 1)
    order = sorted((p * mean / n, t) for t, (n, p) in own.items())
    last = max((k for k, (q, _) in enumerate(order, 1) if q <= rate * k / len(order)), default=0)
    found = {t for _, t in order[:last]}
    return [sorted(base(t) + [(a, 3, b) for a, b, _ in secrets.find(t)[1] if t[a:b] in found]) for t in rows]


def texts():
    rng = random.Random(4)
    bits = ["password=", "Token : '", "api_key", "APIKEY=", "secret=abcdefg", "token=token:abcdef", "AKIA" + "Z9" * 9, "AKIAAKIA12", "deadbeef" * 4, "é漢 ", "\n", "toKen=abcdefgh", "passwd = \"x.y/z+1==\"", "0123456789abcdef01234567"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(8))) for _ in range(300)]


def test_base_spans_stay():
    for t in texts():
        assert secrets.find(t)[0] == base(t)


def planted(rng, n=60):
    """Documents of words, each with one token of a known encoding and length, and as many without."""
    rows, where = [], {}
    words = ["the", "house", "number2", "Street", "north", "city", "plan", "Wiesn-Ausschank", "/usr/share/doc/readme2", "area51_sector_seven_north"]
    for name, alphabet, _ in secrets.ENCODINGS:
        for size in (24, 32, 40, 64):
            for _ in range(n // 4):
                token = "".join(rng.choice(alphabet) for _ in range(size))
                text = " ".join(rng.choice(words) for _ in range(30))
                where[len(rows)] = (name, size, len(text) + 1, len(text) + 1 + size)
                rows.append((len(rows), f"{text} {token} end"))
    return rows + [(len(rows) + i, " ".join(rng.choice(words) for _ in range(40))) for i in range(n * len(secrets.ENCODINGS))], where


def test_battery_finds_planted_tokens_of_each_encoding(spark):
    rows, where = planted(random.Random(1))
    out = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found, false = {}, 0
    for d, spans in out.items():
        hit = d in where and any((s.start, s.end) == where[d][2:] for s in spans)
        false += len([s for s in spans if s.kind == "random"]) - (hit and any(s.kind == "random" for s in spans))
        if d in where:
            found.setdefault(where[d][0], []).append(hit)
    recall = {k: sum(v) / len(v) for k, v in found.items()}
    least = {"base32": 0.7, "base36": 0.7, "base36_upper": 0.7}
    assert all(r >= least.get(k, 0.9) for k, r in recall.items()), recall
    assert false <= 0.02 * sum(map(sum, found.values()))


def test_words_alone_are_no_secrets():
    for t in ("z" * 32 + "1", "Donaudampfschifffahrtsgesellschaft", "q" * 40, "word-" * 9):
        assert secrets.find(t) == ([], [])


def test_cutoff_equals_weighted_benjamini_hochberg(spark):
    rng = random.Random(5)
    for m in (0, 1, 2, 40, 200):
        tested = [(rng.randrange(20, 80), rng.choice([rng.random(), rng.random() ** 8])) for _ in range(m)]
        tested += tested[: m // 4]
        mean = sum(n for n, _ in tested) / len(tested) if tested else 0
        order = sorted(p * mean / n for n, p in tested)
        last = max((k for k, q in enumerate(order, 1) if q <= 0.05 * k / len(order)), default=0)
        limit = secrets.cutoff(spark.createDataFrame(tested, "n long, p double"), 0.05)
        assert sum(p / n <= limit for n, p in tested) == last


def test_many_spans_are_swept_once():
    line = "password=hunter2222 " + "x" * 30 + "1 "
    found, tested = secrets.find(line * 20000)
    assert len(found) == 20000 and not tested


def test_dataframe_cases(spark):
    rows = [(1, "x password=hunter22 y", "s"), (None, None, "s"), (2, "", "s"), (1, "x password=hunter22 y", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = secrets.scan(df).collect()
    assert sorted(r.redacted or "" for r in out) == ["", "", "x <secret> y", "x <secret> y"]
    assert secrets.digests(secrets.scan(df, redacting=False)).where("n_assign = 1").count() == 2
    assert secrets.scan(df.limit(0)).count() == 0
    for row, t in zip(secrets.scan(spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")).orderBy("doc_id").collect(), texts()):
        assert [(s.start, secrets.KINDS.index(s.kind), s.end) for s in row.spans if s.kind != "random"] == base(t)
    rows, _ = planted(random.Random(3), 20)
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    want = brute([t for _, t in rows])
    assert [[(s.start, secrets.KINDS.index(s.kind), s.end) for s in r.spans] for r in got] == want
    assert sum(k == 3 for spans in want for _, k, _ in spans) > 50
    for (_, t), r, spans in zip(rows, got, want):
        assert r.redacted == secrets.redact(t, spans)
