"""Rankings by pairs of alternatives: PROMETHEE with thresholds, ELECTRE I and III, and the spread of ranks under noise.

PROMETHEE's flows need no pairs: for each criterion they follow from counts and sums below two points of the order.
ELECTRE compares all pairs by definition: III in blocks, whatever their number; I takes at most PAIRED alternatives and says
so beyond.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.core.blocks import blocks, over_pairs
from urbanloom.core.ordered import running
from urbanloom.core.tables import stored
from urbanloom.operators.mcda import _shares, _total, ranked

#: Alternatives whose pairs are compared; also the bound of what is broadcast.
PAIRED = 20_000


def _below(values: DataFrame, points: DataFrame) -> DataFrame:
    """(id, n, s): for each point (id, p) the number and sum of the values (x) that are at most p."""
    rows = values.select(F.col("x").alias("k"), F.lit(None).cast(points.schema["id"].dataType).alias("id"), F.lit(0).alias("q"), F.col("x"))
    asked = points.select(F.col("p").alias("k"), "id", F.lit(1).alias("q"), F.lit(None).cast("double").alias("x"))
    counted = F.when(F.col("q") == 0, F.lit(1)).otherwise(F.lit(0))
    out = running(rows.unionByName(asked), [F.col("k"), F.col("q")], {"n": ("sum", counted), "s": ("sum", F.coalesce("x", F.lit(0.0)))})
    return out.where("q = 1").select("id", "n", "s")


def promethee_ii(df: DataFrame, cols: list[str], weights: list[float], benefit: list[bool], thresholds: list[float | None] | None = None) -> DataFrame:
    """Net flow; a difference counts in full from the criterion's threshold on (its range where none is given).

    The preferences of one alternative over all others sum to (x_i - x_k) / t over those within t below it plus the
    number of those further below, and likewise above. A threshold of 0 or less makes any difference count in full.
    """
    box = df.agg(F.count("*").alias("n"), *(f(c).alias(f"{a}_{c}") for c in cols for a, f in (("lo", F.min), ("hi", F.max)))).first()
    n = box["n"]
    parts = df.select("id")
    if n < 2:
        return ranked(df, F.lit(0.0))
    for k, (c, w, good) in enumerate(zip(cols, _shares(weights), benefit)):
        t = (thresholds or [None] * len(cols))[k]
        if t is None:
            t = box[f"hi_{c}"] - box[f"lo_{c}"] or 1.0
        own = stored(df.select("id", ((F.col(c) if good else -F.col(c)).cast("double")).alias("x")), "criterion")

        def worth(side: DataFrame, t: float = t) -> DataFrame:
            """Sum over the others of the preference of x over them."""
            upto = _below(side.select("x"), side.select("id", F.col("x").alias("p"))).withColumnsRenamed({"n": "n1", "s": "s1"})
            far = _below(side.select("x"), side.select("id", (F.col("x") - t).alias("p"))).withColumnsRenamed({"n": "n0", "s": "s0"})
            near = (F.col("n1") - F.col("n0")) * F.col("x") - (F.col("s1") - F.col("s0"))
            return side.join(upto, "id").join(far, "id").select("id", (F.col("n0") + near / t).alias("f"))

        if t > 0:
            over, under = worth(own), worth(own.select("id", (-F.col("x")).alias("x")))
        else:
            less = _below(own.select("x"), own.select("id", F.col("x").alias("p"))).select("id", F.col("n").alias("f"))
            more = _below(own.select((-F.col("x")).alias("x")), own.select("id", (-F.col("x")).alias("p"))).select("id", F.col("n").alias("f"))
            over, under = less, more  # equal values are counted on both sides and cancel
        flow = over.join(under.withColumnRenamed("f", "g"), "id").select("id", (F.lit(w / (n - 1)) * (F.col("f") - F.col("g"))).alias(f"_f{k}"))
        parts = parts.join(flow, "id")
    return ranked(parts, _total([F.col(f"_f{k}") for k in range(len(cols))]))


def _paired(df: DataFrame, cols: list[str], benefit: list[bool]) -> tuple[DataFrame, int]:
    """All ordered pairs (i, k) of different alternatives with d0, d1, ..: how much better i is in each criterion."""
    n = df.count()
    if n > PAIRED:
        raise ValueError(f"{n} alternatives: the method compares all pairs, of {PAIRED} at most")
    a = df.select(F.col("id").alias("i"), *(F.col(c).alias(f"a{j}") for j, c in enumerate(cols)))
    b = df.select(F.col("id").alias("k"), *(F.col(c).alias(f"b{j}") for j, c in enumerate(cols)))
    pairs = a.join(F.broadcast(b), F.col("i") != F.col("k"))
    return pairs.select("i", "k", *(((F.col(f"a{j}") - F.col(f"b{j}")) * (1 if g else -1)).alias(f"d{j}") for j, g in enumerate(benefit))), n


def electre_i(df: DataFrame, cols: list[str], weights: list[float], benefit: list[bool], concordance: float = 0.7, discordance: float = 0.3) -> DataFrame:
    """(id, beats, beaten, kernel): how many others an alternative outranks and is outranked by; the kernel isn't beaten.

    i outranks k if the criteria in which it is as good weigh at least ``concordance`` and its largest shortfall, as a
    share of the criterion's range, is at most ``discordance``.
    """
    box = df.agg(*((F.max(c) - F.min(c)).alias(c) for c in cols)).first()
    pairs, _ = _paired(df, cols, benefit)
    c = _total([F.when(F.col(f"d{j}") >= 0, F.lit(w)).otherwise(F.lit(0.0)) for j, w in enumerate(_shares(weights))])
    short = [F.greatest(-F.col(f"d{j}") / (box[x] or 1.0), F.lit(0.0)) for j, x in enumerate(cols)]
    d = F.greatest(*short) if len(short) > 1 else short[0]
    wins = stored(pairs.where((c >= concordance) & (d <= discordance)).select("i", "k"), "outranks")
    beats, beaten = wins.groupBy(F.col("i").alias("id")).agg(F.count("*").alias("beats")), wins.groupBy(F.col("k").alias("id")).agg(F.count("*").alias("beaten"))
    return df.select("id").join(beats, "id", "left").join(beaten, "id", "left").na.fill(0, ["beats", "beaten"]).withColumn("kernel", F.col("beaten") == 0)


def electre_iii(df: DataFrame, cols: list[str], weights: list[float], benefit: list[bool], q: list[float], p: list[float], v: list[float]) -> DataFrame:
    """Credibility of outranking with indifference, preference and veto thresholds; the score is what an alternative
    has over all others less what they have over it.

    Alternatives that are alike in all criteria are one with their number, so they tie; all pairs of these are weighed in blocks.
    """
    kind, w, names = df.schema["id"].dataType.simpleString(), _shares(weights), [f"_c{j}" for j in range(len(cols))]
    own = stored(df.select("id", *((F.col(c).cast("double") if g else -F.col(c).cast("double")).alias(n) for c, g, n in zip(cols, benefit, names))).na.drop(subset=["id"]).where(" AND ".join(f"{n} IS NOT NULL" for n in names)), "criteria")
    alike = stored(own.groupBy(*names).agg(F.min("id").alias("_k"), F.count("*").cast("double").alias("_n")), "alike")

    def weigh(a: dict, b: dict) -> pd.DataFrame:
        c, veto = np.zeros((len(a["_k"]), len(b["_k"]))), []
        for j, name in enumerate(names):
            short = b[name][None, :] - a[name][:, None]
            none = np.isnan(short)
            c += w[j] * np.where(short <= q[j], 1.0, np.where((short >= p[j]) | none, 0.0, (p[j] - short) / max(1e-9, p[j] - q[j])))
            veto.append(np.where(short <= p[j], 0.0, np.where((short >= v[j]) | none, 1.0, (short - p[j]) / max(1e-9, v[j] - p[j]))))
        credit, rest = c.copy(), np.maximum(1 - c, 1e-9)
        for d in veto:
            credit *= np.where(d > c, (1 - d) / rest, 1.0)
        # an alternative and those like it have as much over each other
        credit[a["_k"][:, None] == b["_k"][None, :]] = 0.0
        over, under = (credit * b["_n"]).sum(axis=1), (credit * a["_n"][:, None]).sum(axis=0)
        return pd.DataFrame({"_k": np.concatenate([a["_k"], b["_k"]]), "_s": np.concatenate([over, -under])})

    cut = blocks(alike, "_k")
    # added up in a fixed order
    sums = over_pairs(cut, cut, weigh, f"_k {kind}, _s double").groupBy("_k").agg(F.aggregate(F.sort_array(F.collect_list("_s")), F.lit(0.0), lambda x, y: x + y).alias("_s"))
    found = own.join(alike.join(sums, "_k"), names).select("id", "_s")
    return ranked(df.select("id").join(found, "id", "left").na.fill(0.0, ["_s"]), F.col("_s"))


def rank_spread(df: DataFrame, cols: list[str], weights: list[float], benefit: list[bool], noise: float = 0.1, simulations: int = 1000, seed: int = 42) -> DataFrame:
    """(id, mean_rank, std_rank, first): ranks of the weighted min-max score under normal noise on the weights, ties by id.

    The weights of all simulations are made on the driver; scores are ordered within each simulation by ranges, so no
    task holds a whole simulation.
    """
    base = np.asarray(weights, float)
    drawn = np.maximum(0.0, base + np.random.Generator(np.random.PCG64(seed)).normal(0.0, noise, (simulations, len(base))))
    total = drawn.sum(axis=1, keepdims=True)
    drawn = np.where(total > 0, drawn / np.where(total > 0, total, 1), 1 / len(base))
    box = df.agg(*(f(c).alias(f"{a}{c}") for c in cols for a, f in (("lo", F.min), ("hi", F.max)))).first()

    def unit(c: str, good: bool) -> Column:
        lo, hi = box[f"lo{c}"], box[f"hi{c}"]
        span = hi - lo if hi is not None and hi - lo > 1e-12 else 1.0
        return (F.col(c) - lo) / span if good else (hi - F.col(c)) / span

    if box[f"lo{cols[0]}"] is None:
        return df.select("id", *(F.lit(0.0).alias(c) for c in ("mean_rank", "std_rank", "first")))
    sims = df.sparkSession.createDataFrame(pd.DataFrame(drawn, columns=[f"w{j}" for j in range(len(cols))]).assign(sim=range(simulations)))
    units = df.select("id", *(unit(c, g).alias(f"u{j}") for j, (c, g) in enumerate(zip(cols, benefit))))
    scores = units.join(F.broadcast(sims), F.lit(True)).select("sim", "id", _total([F.col(f"w{j}") * F.col(f"u{j}") for j in range(len(cols))]).alias("score"))
    ranks = running(scores, [F.col("score").desc(), F.col("id").asc()], {"rank": ("sum", F.lit(1))}, ["sim"])
    return ranks.groupBy("id").agg(F.avg("rank").alias("mean_rank"), F.stddev_pop("rank").alias("std_rank"), F.avg((F.col("rank") == 1).cast("double")).alias("first"))
