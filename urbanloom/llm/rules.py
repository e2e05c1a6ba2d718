"""Quality rules with risk-controlled thresholds.

Each rule rejects a text whose measure exceeds a cutoff. Cutoffs are chosen for each stratum from labelled holdout
rows: a cutoff is allowed only if the exact (Clopper-Pearson) upper bound on the share of good texts that it rejects
stays within the rule's share of the allowed risk. The confidence is split over all strata, rules and cutoffs on the
grid (Bonferroni), so all chosen cutoffs hold together. Among the allowed cutoffs that which rejects most bad texts
is taken; a stratum with too few labelled rows gets no cutoff, and its texts pass.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.core.tables import stored
from urbanloom.llm import kernels as K
from urbanloom.session import ship

#: The risk of rejecting a good text and the confidence in it.
RISK, CONFIDENCE = 0.04, 0.95
#: Measures that rules look at: name, SQL over the counts, and the grid of cutoffs (reject above).
RULES = (
    ("symbols", "n_symbols / greatest(n_words, 1)", (0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0)),
    ("upper", "n_upper / greatest(word_chars, 1)", (0.2, 0.3, 0.4, 0.5, 0.6, 0.7)),
    ("repeats", "n_same_next / greatest(n_words, 1)", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)),
    ("marks", "n_marks / greatest(word_chars, 1)", (0.1, 0.12, 0.15, 0.2, 0.25, 0.3)),
    ("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", (0.3, 0.4, 0.5, 0.6, 0.7)),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_same_next", "n_marks", "n_lines")
#: Fixed by the contract: the symbols, and the words of a window.
SYMBOLS, WINDOW = b"#*$%&|<>", 5
_SYMBOL = K.table(SYMBOLS)
_UPPER = K.table(bytes(range(65, 91)))
_MARK = K.table(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def measure(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The COUNTS of each row, as columns."""
    rows, n = len(offs) - 1, len(data)
    out = np.zeros((len(COUNTS), rows), np.int64)
    if not n:
        return out
    starts, ends, first = K.runs(~K.SPACE[data], offs)

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[offs[1:]] - sums[offs[:-1]]

    out[0] = np.diff(first)
    out[1] = total(~K.SPACE[data] & ((data & 0xC0) != 0x80))
    out[2] = total(_SYMBOL[data])
    out[5] = total(_UPPER[data])
    out[7] = total(_MARK[data])
    row = np.repeat(np.arange(rows), out[0])
    # lines with a word: a line is a run without \n that holds the start of a word
    a, b, lines = K.runs(data != 10, offs)
    full = np.searchsorted(starts, a) < np.searchsorted(starts, b)
    a, b = a[full], b[full]
    owner = np.searchsorted(offs, a, "right") - 1
    out[8] = np.bincount(owner, minlength=rows)
    out[3] = out[8] - np.bincount(owner[_firsts(K.exact_ids(data, a, b), owner)], minlength=rows)
    if len(starts):
        words = K.exact_ids(data, starts, ends)
        out[6] = np.bincount(row[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])], minlength=rows)
        if len(words) >= WINDOW:
            inside = row[WINDOW - 1 :] == row[: len(row) - WINDOW + 1]
            at = np.flatnonzero(inside)
            keys = K.mix(K.window_hash(words.astype(np.uint64), WINDOW)[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(keys, kind="stable")
            same = keys[order][1:] == keys[order][:-1]
            twice = np.zeros(len(keys), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            # windows whose hashes agree, told apart by their words
            at = at[twice]
            whole = np.stack([row[at], *(words[at + j] for j in range(WINDOW))], axis=1)
            _, which, times = np.unique(whole, axis=0, return_inverse=True, return_counts=True)
            at = at[times[which.reshape(-1)] > 1]
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + WINDOW, -1)
            out[4] = np.bincount(row[np.cumsum(step[:-1]) > 0], minlength=rows)
    return out


def _firsts(ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Index of the first occurrence of each (owner, id)."""
    return np.unique(owner * (int(ids.max(initial=0)) + 1) + ids, return_index=True)[1]


def measures(df: DataFrame, carry: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``carry`` and the COUNTS for each row; a null text counts as empty. Other columns are not read."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            parts = [measure(data, offs) for _, data, offs in K.chunks(batch.column(len(carry)))]
            got = np.concatenate(parts, axis=1) if parts else np.zeros((len(COUNTS), 0), np.int64)
            yield pa.record_batch([*batch.columns[: len(carry)], *(pa.array(c) for c in got)], names=[*carry, *COUNTS])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    return df.select(*carry, F.col(text_col).cast("string").alias("_text_")).mapInArrow(run, schema + "".join(f", {c} long" for c in COUNTS))


def upper_bound(k: int, n: int, alpha: float) -> float:
    """Exact binomial upper bound: the rate at which k or fewer of n have probability alpha."""
    if n == 0 or k >= n:
        return 1.0
    log_ways = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    def tail(p: float) -> float:
        # p is above k / n, so the terms from k down to 0 fall and soon no longer count
        if not 0 < p < 1:
            return float(p <= 0)
        term = total = math.exp(log_ways + k * math.log(p) + (n - k) * math.log1p(-p))
        i = k
        while i and term > total * 1e-17:
            term *= i * (1 - p) / ((n - i + 1) * p)
            total += term
            i -= 1
        return total

    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        lo, hi = (p, hi) if tail(p) > alpha else (lo, p)
    return hi


def calibrate(rows: list[tuple], risk: float = RISK, confidence: float = CONFIDENCE) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and rule from (stratum, good, measure of each rule) rows."""
    tallies: dict[tuple, list[int]] = {}
    for s, good, *values in rows:
        own = tallies.setdefault((s, bool(good)), [0] * (1 + sum(len(grid) for _, _, grid in RULES)))
        for k, over in enumerate([True, *(v > c for v, (_, _, grid) in zip(values, RULES) for c in grid)]):
            own[k] += over
    return cutoffs(tallies, risk, confidence)


def cutoffs(tallies: dict[tuple, list[int]], risk: float = RISK, confidence: float = CONFIDENCE) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and rule from the number of rows of each (stratum, good) and how many exceed each cutoff."""
    strata = sorted({s for s, _ in tallies})
    none = [0] * (1 + sum(len(grid) for _, _, grid in RULES))
    alpha, limit = (1 - confidence) / max(1, len(strata) * (len(none) - 1)), risk / len(RULES)
    out: dict[str, dict[str, float]] = {}
    for s in strata:
        good, bad = tallies.get((s, True), none), tallies.get((s, False), none)
        k = 0
        for name, _, grid in RULES:
            allowed = []
            for c in grid:
                k += 1
                if good[k] <= limit * good[0] and upper_bound(good[k], good[0], alpha) <= limit:
                    allowed.append((bad[k], c))
            best = max(allowed, default=(0, 0.0))
            if best[0]:
                out.setdefault(s, {})[name] = best[1]
    return out


def tally(measured: DataFrame, labels: DataFrame, stratum: str, id_col: str, label: str) -> dict[tuple, list[int]]:
    """What ``cutoffs`` needs, counted over all rows with a label and a stratum.

    Ids with several labels count once (the largest label), null ids and labels are left out.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("_label"))
    over = [F.count_if(F.expr(sql) > float(c)) for _, sql, grid in RULES for c in grid]
    rows = measured.where(F.col(stratum).isNotNull()).join(own, id_col).groupBy(stratum, (F.col("_label") != 0).alias("_good"))
    return {(r[0], r[1]): list(r[2:]) for r in rows.agg(F.count("*"), *(c.alias(f"_over{k}") for k, c in enumerate(over))).collect()}


def verdicts(df: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """``id_col``, the COUNTS, ``base_failed``, ``failed_rules`` and ``kept`` for each row.

    Cutoffs are calibrated on all labelled rows. Rows with a null or unlabelled stratum have no cutoffs beyond the base
    rule; an empty table gives an empty one; repeated rows and null ids are kept.
    """
    every = stored(measures(df, tuple(dict.fromkeys((id_col, stratum)))), "measures")
    failed = [
        F.when(F.coalesce((F.col(stratum) == s) & (F.expr(sql) > own[name]), F.lit(False)), F.lit(name))
        for s, own in cutoffs(tally(every, labels, stratum, id_col, label)).items()
        for name, sql, _ in RULES
        if name in own
    ]
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rules = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return every.select(id_col, *COUNTS, base.alias("base_failed"), rules.alias("failed_rules"), (~base & (F.size(rules) == 0)).alias("kept"))
