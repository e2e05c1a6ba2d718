"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Patterns find assignments, access keys and long hex runs. The battery looks at every other long run of encoding
characters: it infers the encoding, tests whether its symbols are spread as a random string's would be (chi-squared
uniformity, runs about the median, serial correlation) and whether that spread is too even for ordinary words. The
p-values against ordinary words are held to a false-discovery rate over the whole table with weights by length
(weighted Benjamini-Hochberg), so short candidates need stronger evidence. A string is one hypothesis however often it
occurs. A first scan gathers the hypotheses and gives the cutoff, a second one applies it.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.core.ordered import numbered
from urbanloom.llm import kernels as K
from urbanloom.llm.storage import stored
from urbanloom.session import ship

#: Fixed by the contract: the base patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")
_HEX_LONG = re.compile(r"[0-9a-f]{24,}")
#: Every assignment has one of these, in either case.
_HINTS = (b"passw", b"secret", b"token", b"api")

#: Candidates for the battery, the false-discovery rate and the level below which a randomness test speaks against.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
FDR, LEVEL = 0.01, 0.001
#: Alphabets in the order in which they are tried: name, characters, and the noncentrality for each character that
#: ordinary words would give the chi-squared statistic (their letters' departure from the uniform distribution).
_LOW, _UP, _NUM = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("hex", _NUM + "abcdef", 2.0),
    ("hex_upper", _NUM + "ABCDEF", 2.0),
    ("base32", _UP + "234567", 1.1),
    ("base36", _LOW + _NUM, 1.4),
    ("base36_upper", _UP + _NUM, 1.4),
    ("base62", _UP + _LOW + _NUM, 3.0),
    ("base64", _UP + _LOW + _NUM + "+/", 3.1),
    ("base64url", _UP + _LOW + _NUM + "-_", 3.1),
)


def _tail(z: float) -> float:
    """Upper tail of the normal distribution."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_z(x: float, df: float) -> float:
    """Wilson-Hilferty: the normal score of a chi-squared value."""
    return ((max(x, 0.0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))


def infer(body: str) -> tuple[str, str, float] | None:
    """The smallest alphabet that holds all characters, if there are letters and digits; words alone have no encoding."""
    chars = set(body)
    if not any(c in _NUM for c in chars) or not any(c not in _NUM for c in chars):
        return None
    return next((e for e in ENCODINGS if chars <= set(e[1])), None)


def battery(body: str) -> dict | None:
    """Encoding, the three tests' p-values under randomness, and p_words under ordinary words; None without encoding."""
    found = infer(body)
    if found is None:
        return None
    name, alphabet, noncentral = found
    m, n = len(alphabet), len(body)
    index = {c: i for i, c in enumerate(alphabet)}
    x = [index[c] for c in body]
    counts = [0] * m
    for v in x:
        counts[v] += 1
    chi2 = sum(c * c for c in counts) * m / n - n
    df = m - 1
    p_uniform = _tail(_chi2_z(chi2, df))
    mid = (m - 1) / 2
    above = [v > mid for v in x]
    n1 = sum(above)
    n2 = n - n1
    if n1 and n2:
        changes = 1 + sum(a != b for a, b in zip(above, above[1:]))
        mean = 1 + 2 * n1 * n2 / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p_runs = min(1.0, 2 * _tail(abs(changes - mean) / math.sqrt(var)))
    else:
        p_runs = 2.0 ** (1 - n)
    avg = sum(x) / n
    spread = sum((v - avg) ** 2 for v in x)
    r = sum((a - avg) * (b - avg) for a, b in zip(x, x[1:])) / spread if spread else 1.0
    p_serial = min(1.0, 2 * _tail(abs(r + 1 / n) * math.sqrt(n)))
    # under ordinary words the statistic is about a scaled chi-squared with noncentrality n * noncentral
    lam = n * noncentral
    scale, dfs = (df + 2 * lam) / (df + lam), (df + lam) ** 2 / (df + 2 * lam)
    p_words = 1 - _tail(_chi2_z(chi2 / scale, dfs))
    return {"encoding": name, "p_uniform": p_uniform, "p_runs": p_runs, "p_serial": p_serial, "p_words": p_words}


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]:
    """Pattern spans (start, kind, end), sorted, kinds numbering KINDS; and (start, end, p_words) of the candidates.

    Candidates look random by all three tests and never overlap a pattern span.
    """
    out = []
    low = text.encode("utf-8").lower()
    if any(x in low for x in _HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    tested = []
    long = [m.span() for m in CANDIDATE.finditer(text)]
    if long:
        out += [(m.start(), 2, m.end()) for m in _HEX_LONG.finditer(text)]
        begins = sorted(a for a, _, _ in out)
        reach, upto = [], 0
        for b in (b for _, b in sorted((a, b) for a, _, b in out)):
            upto = max(upto, b)
            reach.append(upto)
        for a, b in long:
            before = bisect_left(begins, b)
            if before and reach[before - 1] > a:
                continue
            got = battery(text[a:b].rstrip("="))
            if got and min(got["p_uniform"], got["p_runs"], got["p_serial"]) >= LEVEL:
                tested.append((a, b, got["p_words"]))
    out.sort()
    return out, tested


_RUN = K.table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def rows_to_scan(data, offs, hints: bool = True) -> list[bool]:
    """Rows that hold a run of 20 candidate characters or (``hints``) the start of an assignment; no other row has a span."""
    starts, ends, first = K.runs(_RUN[data], offs)
    long = np.concatenate([[0], np.cumsum(ends - starts >= 20)])
    low = data.tobytes().lower() if hints else b""
    if not any(x in low for x in _HINTS):
        return (long[first[1:]] > long[first[:-1]]).tolist()
    return [bool(n) or any(x in low[a:b] for x in _HINTS) for n, a, b in zip(long[first[1:]] - long[first[:-1]], offs[:-1], offs[1:])]


def hypotheses(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(n, p): length and p-value of each distinct candidate string of the texts."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            for a, data, offs in K.chunks(batch.column(0)):
                part = batch.column(0).slice(a, len(offs) - 1)
                found: dict[bytes, tuple[int, float]] = {}
                for i, wanted in enumerate(rows_to_scan(data, offs, hints=False)):
                    text = part[i].as_py() if wanted else ""
                    for x, y, p in find(text)[1] if wanted else ():
                        found[hashlib.sha256(text[x:y].encode()).digest()[:16]] = (y - x, p)
                yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([p for _, p in found.values()], pa.float64())], names=["h", "n", "p"])

    rows = df.select(F.col(text_col).cast("string").alias("_text_")).mapInArrow(run, "h binary, n long, p double")
    return rows.groupBy("h").agg(F.first("n").alias("n"), F.first("p").alias("p")).select("n", "p")


def cutoff(tested: DataFrame, rate: float = FDR) -> float:
    """Weighted Benjamini-Hochberg over (n, p), weights n over their mean: discoveries are those with p / n up to this."""
    tested = stored(tested, "hypotheses")
    m, total = tested.agg(F.count("*"), F.sum("n")).first()
    if not m:
        return -1.0
    # k of m candidates are found if the k-th least p * mean / n is at most rate * k / m; ranks of those that can be
    some = tested.select((F.col("p") / F.col("n")).alias("q"), "n").where(F.col("q") * (total / m) <= rate)
    ranked = numbered(some, [F.col("q"), F.col("n")], "k")
    last = ranked.where(F.col("q") * (total / m) <= F.lit(rate) * F.col("k") / m).agg(F.max("q")).first()[0]
    return -1.0 if last is None else float(last)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), redacting: bool = True, rate: float = FDR) -> DataFrame:
    """``id_col``, ``carry``, ``spans`` (kind, start, end in code points, end exclusive; by start, then kind) and
    ``redacted`` (the text with each covered stretch replaced by ``<secret>``; null without ``redacting``) for each row.

    Null and empty texts have no spans (a null text stays null when redacted). Repeated rows and null ids are kept,
    ties of start are ordered as KINDS is; other columns are not read. Random strings are found at the false-discovery
    rate ``rate`` over all texts of ``df``, which is read twice. An empty table gives an empty one.
    """
    ship(df.sparkSession)
    limit = cutoff(hypotheses(df, text_col), rate)
    names = [id_col, *(c for c in carry if c != id_col)]
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(len(names))
            for a, data, offs in K.chunks(texts):
                part = texts.slice(a, len(offs) - 1)
                spans, clean = [], []
                for i, wanted in enumerate(rows_to_scan(data, offs)):
                    text = part[i].as_py() if wanted or redacting else None
                    found, tested = find(text) if wanted else ([], [])
                    found = sorted([*found, *((x, 3, y) for x, y, p in tested if p / (y - x) <= limit)])
                    spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found])
                    clean.append(redact(text, found) if redacting else None)
                yield pa.record_batch([*(c.slice(a, len(spans)) for c in batch.columns[: len(names)]), pa.array(spans, kinds), pa.array(clean, pa.string())], names=[*names, "spans", "redacted"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.select(*names, F.col(text_col).cast("string").alias("_text_")).mapInArrow(run, f"{schema}, spans array<struct<kind:string,start:int,end:int>>, redacted string")


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], "<secret>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digests(df: DataFrame) -> DataFrame:
    """What the query returns of ``scan``."""
    base = F.filter("spans", lambda s: s["kind"] != "random")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
