"""Toxicity: a support vector machine over a subsequence string kernel, with Nystrom landmarks.

The kernel compares words by their common subsequences of three characters, each discounted by the stretch that it
spans in either word, so gapped insults and inserted characters lower the similarity but don't end it. Words are runs
without white space, lower-cased, marks inside them dropped; runs of single characters ("i d i o t") are one word
more. Labels are of documents: sentences of toxic ones are labelled by their words' four-grams that clean ones lack,
and the machine learns to tell those words (and spoilt copies of them) from the words of clean sentences. A document
scores by its most toxic words and their number, through a logistic curve fitted on the training documents.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.llm import kernels as K
from urbanloom.llm.training import held_out, sample
from urbanloom.session import ship

#: Labelled documents that training reads at most (and at most training.TRAINING_BYTES of text); landmarks, which bound
#: the model's size.
TRAINING_ROWS, LANDMARKS = 6000, 28
#: Bounds of training alone: sentences of either label, insulting words, their stems that can become landmarks, insults
#: of which spoilt copies are made, words drawn from clean texts, and the hardest clean words added in each round.
SENTENCES, INSULTS, STEMS, SPOILT, DRAWN, HARD = 4000, 3000, 400, 500, 8000, 2000
#: Decay of the kernel for each character spanned, length of the subsequences (the code is for three), longest word compared at once
#: (longer ones are cut into overlapping pieces) and longest landmark.
DECAY, LENGTH, LONGEST, LANDMARK_LONGEST = 0.7, 3, 14, 9
#: The score of words that are shorter than a subsequence, and the least one of others.
FLOOR = -2.0
#: Word scores above which words are counted, and the number of a document's features.
LEVELS, FEATURES = (0.3, 0.6, 0.9), 7
#: Word scores kept by a Python worker (memory only).
KEPT = 400_000

_MARK = np.zeros(256, bool)
_MARK[:128] = True
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = False
_SCORES: dict[str, dict[int, float]] = {}


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kept bytes, and start, end and row of each word in them."""
    low = K.LOWER[data]
    space = K.SPACE[low]
    starts, ends, first = K.runs(~space, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    keep = ~_MARK[low]
    place = np.concatenate([[0], np.cumsum(keep)])
    kept = low[keep]
    a, b = place[starts], place[ends]
    full = b > a
    a, b, row = a[full], b[full], row[full]
    # single characters in a row: one character is one byte, or one byte that begins a character and its followers
    lead = np.concatenate([[0], np.cumsum((kept & 0xC0) != 0x80)])
    single = lead[b] - lead[a] == 1
    if single.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        extra = []
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
            for r in np.unique(row[x:y]).tolist() if y - x >= 4 else ():
                own = np.flatnonzero(row[x:y] == r) + x
                if len(own) >= 4:
                    extra.append((a[own[0]], b[own[-1]], r))
        if extra:
            a, b, row = (np.concatenate([u, np.array(v)]) for u, v in zip((a, b, row), zip(*extra)))
    long = b - a > LONGEST
    if long.any():
        pieces = [(s, min(s + LONGEST, y), r) for x, y, r in zip(a[long].tolist(), b[long].tolist(), row[long].tolist()) for s in range(x, max(x + 1, y - LONGEST // 2), LONGEST // 2)]
        a, b, row = (np.concatenate([u[~long], np.array(v)]) for u, v in zip((a, b, row), zip(*pieces)))
    return kept, a, b, row


def matrix(kept: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of bytes, filled up with zeros, and their lengths."""
    n = b - a
    at = a[:, None] + np.arange(max(1, int(n.max(initial=1))))[None, :]
    inside = at < b[:, None]
    return np.where(inside, kept[np.minimum(at, max(len(kept) - 1, 0))], 0).astype(np.uint8) if len(kept) else np.zeros((len(a), 1), np.uint8), n


def rows_of(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), max(map(len, texts), default=1)), np.uint8)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t, np.uint8)
    return out


def _raw(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Unnormalised kernel of words x (n, L) with words t: (m, T) for all pairs, or (n, 1, T) for words of their own."""
    n, m, size = len(x), t.shape[-2], t.shape[-1]
    steps = np.triu(np.float32(DECAY) ** (np.arange(size)[None, :] - np.arange(size)[:, None]).clip(0)).astype(np.float32)
    d, d2 = np.float32(DECAY), np.float32(DECAY * DECAY)
    if t.ndim == 2:  # where each byte stands in each landmark
        found = np.zeros((256, m, size), np.float32)
        for i in range(m):
            found[t[i], i, np.arange(size)] = d2
        found[0] = 0
    one, two = np.zeros((n, m, size), np.float32), np.zeros((n, m, size), np.float32)
    total = np.zeros((n, m), np.float32)
    for k in range(x.shape[1]):
        match = found[x[:, k]] if t.ndim == 2 else np.where((t == x[:, k][:, None, None]) & (t != 0), d2, np.float32(0))
        total += np.einsum("nmt,nmt->nm", match[:, :, 1:], two[:, :, :-1])
        longer = np.zeros((n, m, size), np.float32)
        np.multiply(match[:, :, 1:], one[:, :, :-1], out=longer[:, :, 1:])
        two *= d
        two += (longer.reshape(-1, size) @ steps).reshape(n, m, size)
        one *= d
        one += (match.reshape(-1, size) @ steps).reshape(n, m, size)
    return total


def kernel(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Normalised kernel (n, m) of the words in the rows of x and t; words without a subsequence of LENGTH give 0."""
    out = np.zeros((len(x), len(t)), np.float32)
    own_t = np.sqrt(_raw(t, t[:, None, :])[:, 0]) if len(t) else np.zeros(0)
    for i in range(0, len(x), 256):
        part = x[i : i + 256]
        part = part[:, : max(1, int((part != 0).sum(axis=1).max(initial=1)))]
        own = np.sqrt(_raw(part, part[:, None, :])[:, 0])
        out[i : i + 256] = _raw(part, t) / np.maximum(own[:, None] * own_t[None, :], 1e-12)
    return out


class Model:
    """Landmarks and the machine's weights on the kernel with them; the curve from word scores to probability."""

    def __init__(self, landmarks: list[bytes], beta: np.ndarray, bias: float, slope: np.ndarray, shift: float):
        self.rows, self.beta, self.bias, self.slope, self.shift = rows_of(landmarks), beta, bias, slope, shift

    def values(self, x: np.ndarray) -> np.ndarray:
        return kernel(x, self.rows) @ self.beta + np.float32(self.bias)

    def word_scores(self, kept: np.ndarray, a: np.ndarray, b: np.ndarray, known: dict[int, float]) -> np.ndarray:
        """Scores of words; those seen before are looked up in ``known``."""
        out = np.full(len(a), FLOOR, np.float32)
        wanted = np.flatnonzero(b - a >= LENGTH) if len(self.beta) else np.zeros(0, np.int64)
        if not len(wanted):
            return out
        keys, first, inverse = np.unique(K.span_hash(kept, a[wanted], b[wanted]), return_index=True, return_inverse=True)
        got = np.array([known.get(k, np.nan) for k in keys.tolist()], np.float32)
        new = np.flatnonzero(np.isnan(got))
        if len(new):
            at = wanted[first[new]]
            order = np.argsort(b[at] - a[at], kind="stable")
            rows, _ = matrix(kept, a[at[order]], b[at[order]])
            got[new[order]] = np.maximum(self.values(rows), FLOOR)
            if len(known) > KEPT:
                known.clear()
            known.update(zip(keys[new].tolist(), got[new].tolist()))
        out[wanted] = got[inverse]
        return out

    def features(self, data: np.ndarray, offs: np.ndarray, known: dict[int, float]) -> np.ndarray:
        """For each row its three highest word scores (clipped), the logarithms of how many words score above each of
        LEVELS, and the share of the middle one in all words."""
        rows = len(offs) - 1
        out = np.zeros((rows, FEATURES))
        out[:, :3] = -0.5
        kept, a, b, row = words(data, offs)
        if not len(a):
            return out
        # each distinct word once
        _, first, inverse = np.unique(K.span_hash(kept, a, b), return_index=True, return_inverse=True)
        score = self.word_scores(kept, a[first], b[first], known)[inverse]
        for i, level in enumerate(LEVELS):
            high = np.bincount(row[score > level], minlength=rows)
            out[:, 3 + i] = np.log1p(high)
            if i == 1:
                out[:, 6] = np.minimum(10 * high / np.maximum(np.bincount(row, minlength=rows), 20), 2)
        some = np.flatnonzero(score > FLOOR)
        some = some[np.lexsort((-score[some], row[some]))]
        place = np.arange(len(some)) - np.searchsorted(row[some], row[some])
        top = place < 3
        out[row[some[top]], place[top]] = np.clip(score[some[top]], -0.5, 1.5)
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.slope + self.shift, -35, 35)))


def machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 25, penalty: float = 1e-3) -> np.ndarray:
    """Linear support vector machine (squared hinge), by Newton steps; the last weight is the bias."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float64)
    w = np.zeros(z.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[-1, -1] = 1e-8
    for _ in range(rounds):
        on = y * (z @ w) < 1
        zo, co = z[on], cost[on]
        new = np.linalg.solve(ridge + (zo * co[:, None]).T @ zo, (zo * co[:, None]).T @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _distinct(texts: pa.Array) -> list[set[bytes]]:
    out = []
    for _, data, offs in K.chunks(texts):
        kept, a, b, row = words(data, offs)
        raw = kept.tobytes()
        own: list[set[bytes]] = [set() for _ in range(len(offs) - 1)]
        for x, y, r in zip(a.tolist(), b.tolist(), row.tolist()):
            own[r].add(raw[x:y])
        out += own
    return out


def _grams(word: bytes) -> set[bytes]:
    w = b"^" + word + b"$"
    return {w[i : i + n] for n in (4, 6) for i in range(max(1, len(w) - n + 1))}


def _core(word: bytes, telling: dict[bytes, int]) -> bytes:
    """The stretch about the word's commonest telling four-gram whose four-grams are at least half as common."""
    w = b"^" + word + b"$"
    n = [max(telling.get(w[i : i + 4], 0), *(telling.get(w[j : j + 6], 0) for j in range(max(0, i - 2), i + 1))) for i in range(max(1, len(w) - 3))]
    top = max(n)
    if not top:
        return b""
    lo = hi = n.index(top)
    while lo and 2 * n[lo - 1] >= top:
        lo -= 1
    while hi + 1 < len(n) and 2 * n[hi + 1] >= top:
        hi += 1
    return w[lo : hi + 4].strip(b"^$")[:LANDMARK_LONGEST]


def _spoilt(word: bytes, rng: np.random.Generator) -> list[bytes]:
    """Copies with one character put in, doubled or (in longer words) left out."""
    k = int(rng.integers(1, len(word)))
    c = bytes([int(rng.integers(97, 123))])
    out = [word[:k] + c + word[k:], word[:k] + word[k - 1 :]]
    return [*out, word[:k] + word[k + 1 :]] if len(word) > 6 else out


def _sentences(texts: pa.Array, labels: np.ndarray, insults: dict[bytes, int], most: int = SENTENCES) -> tuple[pa.Array, np.ndarray]:
    """Labelled sentences: of toxic texts those that hold an insult, of clean ones all, ``most`` of either at most."""
    out: list[list[str]] = [[], []]
    for text, y in zip(texts.to_pylist(), labels):
        side = out[int(y > 0)]
        for part in re.split(r"(?<=[.!?])\s+|\n", text or "") if len(side) < most else ():
            if part.strip() and (not y or any(w.lower().strip(".,!?").encode() in insults for w in part.split())):
                side.append(part)
    clean, toxic = out[0][:most], out[1][:most]
    return pa.array(clean + toxic, pa.string()), np.array([0] * len(clean) + [1] * len(toxic))


def train(texts: pa.Array, labels: np.ndarray, landmarks: int = LANDMARKS) -> Model:
    """From texts and their labels; without a word that sets toxic texts apart every text scores their share."""
    docs = _distinct(texts)
    toxic, clean = [d for d, y in zip(docs, labels) if y], [d for d, y in zip(docs, labels) if not y]
    share = np.clip(len(toxic) / max(len(docs), 1), 0.01, 0.49)
    constant = Model([], np.zeros(0, np.float32), FLOOR, np.zeros(FEATURES), float(np.log(share / (1 - share))))
    counts: list[dict[bytes, int]] = [{}, {}]
    for c, part in zip(counts, (toxic, clean)):
        for d in part:
            for g in set().union(*map(_grams, d)) if d else ():
                c[g] = c.get(g, 0) + 1
    odds = {g: np.log((k + 0.5) / (len(toxic) + 1)) - np.log((counts[1].get(g, 0) + 0.5) / (len(clean) + 1)) for g, k in counts[0].items() if k >= max(4, 0.012 * len(toxic))}
    telling = {g: counts[0][g] for g, v in odds.items() if v >= 2.0}
    sides: list[dict[bytes, int]] = [{}, {}]
    for side, part in zip(sides, (toxic, clean)):
        for d in part:
            for w in d:
                if LENGTH <= len(w) <= LONGEST:
                    side[w] = side.get(w, 0) + 1
    ratio = len(clean) / max(len(toxic), 1)
    insults = {w: n for w, n in sides[0].items() if n * ratio >= 4 * sides[1].get(w, 0) and _grams(w) & telling.keys()}
    cores: dict[bytes, int] = {}
    for w, n in insults.items():  # an insult that recurs as it is stands for itself, else its stem does
        core = w[:LANDMARK_LONGEST] if 2 * n >= max(telling.get(g, 0) for g in _grams(w)) else _core(w, telling)
        cores[core] = cores.get(core, 0) + n
    if not any(len(c) >= LENGTH for c in cores):
        return constant
    rng = np.random.Generator(np.random.PCG64(11))
    ordered = sorted(insults, key=lambda w: (-insults[w], w))[:INSULTS]
    pool = sorted(w for w in sides[1] if w not in insults)
    often = np.array([sides[1][w] for w in pool], np.float64)
    # landmarks: the core least like those taken so far, by how often it occurs; then a few words of clean texts
    first = sorted((c for c in cores if len(c) >= LENGTH), key=lambda c: (-cores[c], c))[:STEMS]
    like = kernel(rows_of(first), rows_of(first))
    weight = np.log1p([cores[c] for c in first])
    taken, near = [0], like[:, 0].copy()
    while len(taken) < min(landmarks * 5 // 6, len(first)):
        k = int(np.argmax((1 - near) * weight))
        taken.append(k)
        near = np.maximum(near, like[:, k])
    toxic_marks = [first[k] for k in taken]
    short = [w for w in pool if len(w) <= LANDMARK_LONGEST]
    marks = toxic_marks + ([short[i] for i in rng.choice(len(short), min(landmarks - len(toxic_marks), len(short)), replace=False)] if short else [])
    zz = kernel(rows_of(marks), rows_of(marks)).astype(np.float64)
    value, vector = np.linalg.eigh((zz + zz.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    copies = [(s, w) for w in ordered[:SPOILT] for s in _spoilt(w, rng)]
    yes = ordered + [s for s, _ in copies]
    worth = np.sqrt([insults[w] for w in ordered] + [insults[w] for _, w in copies])
    worth /= worth.sum()
    drawn = [pool[i] for i in rng.choice(len(pool), min(DRAWN, len(pool)), replace=False)] if pool else []
    seen = {w: i for i, w in enumerate(pool)}
    k_yes = kernel(rows_of(yes), rows_of(marks))
    k_pool = kernel(rows_of(pool), rows_of(marks))
    no = sorted({seen[w] for w in drawn})
    beta, bias = np.zeros(len(marks)), 0.0
    for _ in range(4):  # each time with the clean words that are hardest so far
        k_no, common = k_pool[no], often[no]
        x = np.concatenate([k_yes, k_no]) @ root
        y = np.concatenate([np.ones(len(k_yes)), -np.ones(len(k_no))])
        cost = np.concatenate([worth, common / max(common.sum(), 1)]) * 100
        w = machine(x, y, cost)
        beta, bias = root @ w[:-1], float(w[-1])
        hard = np.argsort(-(k_pool @ beta))[:HARD].tolist()
        more = sorted(set(no) | set(hard))
        if more == no:
            break
        no = more
    model = Model(marks, beta.astype(np.float32), bias, np.zeros(FEATURES), 0.0)
    known: dict[int, float] = {}
    parts, marked = _sentences(texts, labels, insults)
    z = np.concatenate([model.features(data, offs, known) for t in (texts, parts) for _, data, offs in K.chunks(t)])
    z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    y, v = np.concatenate([(np.asarray(labels) > 0), marked]).astype(np.float64), np.zeros(z.shape[1])
    # sentences weigh half as much as documents, so that one insult in a short text is known as well
    c = np.concatenate([np.ones(len(texts)), np.full(len(parts), 0.5 * len(texts) / max(len(parts), 1))])
    for _ in range(50):  # logistic curve by Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ v, -35, 35)))
        v = v + np.linalg.solve((z * (c * p * (1 - p))[:, None]).T @ z + 3e-2 * np.eye(len(v)), z.T @ (c * (y - p)) - 3e-2 * v)
    model.slope, model.shift = v[:-1], float(v[-1])
    return model


def fit(df: DataFrame, labels: DataFrame, keep, label: str = "toxic", rows: int = TRAINING_ROWS) -> Model:
    """A model from at most ``rows`` labelled documents, trained in one task; the driver gets the model alone."""
    ship(df.sparkSession)

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts)
            model = train(t.column("_text").combine_chunks(), t.column("_label").to_numpy())
            yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], names=["m"])

    drawn = sample(df, labels, label, keep, rows)
    got = drawn.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.xxhash64("_text")).mapInArrow(run, "m binary").collect()
    return pickle.loads(bytes(got[0]["m"])) if got else Model([], np.zeros(0, np.float32), FLOOR, np.zeros(FEATURES), -2.0)


def scores_of(name: str) -> dict[int, float]:
    """The worker's memo of word scores for one model."""
    if name not in _SCORES:
        _SCORES.clear()
        _SCORES[name] = {}
    return _SCORES[name]


def classify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (0 to 1) and ``best`` (the highest word score) for each row.

    Null and empty texts and texts of short words alone get the lowest word scores. Repeated rows and null ids are
    kept, an empty table gives an empty one, other columns are not read. A text's words are all looked at.
    """
    import uuid

    ship(df.sparkSession)
    sent, name = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        known = scores_of(name)
        for batch in batches:
            parts = [sent.value.features(data, offs, known) for _, data, offs in K.chunks(batch.column(1), K.CHUNK // 2)]
            z = np.concatenate(parts) if parts else np.zeros((0, FEATURES))
            yield pa.record_batch([batch.column(0), pa.array(sent.value.probability(z)), pa.array(z[:, 0])], names=[id_col, "score", "best"])

    return df.select(id_col, F.col(text_col).cast("string").alias("_text_")).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, score double, best double")


def toxicity(df: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, threshold: float = 0.5) -> DataFrame:
    """Fits on labelled rows that are not held out and scores every row: held_out, score, predicted."""
    model = fit(df, labels, ~held_out("doc_id", modulus, remainder))
    return classify(df, model).select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
