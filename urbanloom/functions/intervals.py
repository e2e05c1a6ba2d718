"""Parts of an edge that can be reached, as arrays of intervals (lo, hi) of its length from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
_NONE = "cast(array() as array<struct<lo:double,hi:double>>)"


def piece(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


def _clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def reach(from_src: Column, from_dst: Column, cost: Column, cutoff: float) -> Column:
    """struct<whole, a, b>: the shares of an edge that the costs of its ends leave; unknown and infinite costs leave none."""

    def share(d: Column) -> Column:
        known = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
        return F.when(known, _clip((cutoff - d) / F.greatest(cost, F.lit(EPS)))).otherwise(F.lit(0.0))

    a, b = share(from_src), share(from_dst)
    return F.struct((a + b >= 1 - EPS).alias("whole"), a.alias("a"), b.alias("b"))


def of_edge(r: Column) -> Column:
    """The intervals that a ``reach`` stands for."""
    ends = F.array(piece(F.lit(0.0), r["a"]), piece(1 - r["b"], F.lit(1.0)))
    return F.when(r["whole"], F.array(piece(F.lit(0.0), F.lit(1.0)))).otherwise(F.filter(ends, lambda x: x["hi"] - x["lo"] > EPS))


def about(t: Column, snap: Column, cost: Column, cutoff: float) -> Column:
    """The interval about an entry at ``t`` that costs ``snap`` to get to; null if the budget doesn't reach it."""
    span = (cutoff - snap) / F.greatest(cost, F.lit(EPS))
    lo, hi = F.greatest(t - span, F.lit(0.0)), F.least(t + span, F.lit(1.0))
    return F.when((cutoff - snap > EPS) & (hi - lo > EPS), piece(lo, hi))


def merged(c: Column) -> Column:
    """Cut to 0..1, in order, with those that touch made one."""
    cut = F.filter(F.transform(c, lambda x: piece(F.greatest(x["lo"], F.lit(0.0)), F.least(x["hi"], F.lit(1.0)))), lambda x: x["hi"] - x["lo"] > EPS)

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        wider = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(piece(last["lo"], F.greatest(last["hi"], x["hi"]))))
        return F.when((F.size(acc) > 0) & (x["lo"] <= last["hi"] + EPS), wider).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(cut), F.expr(_NONE), step)


def without(a: Column, b: Column) -> Column:
    """The intervals of ``a`` less those of ``b``."""

    def cut(pieces: Column, x: Column) -> Column:
        def rest(p: Column) -> Column:
            apart = (x["hi"] <= p["lo"] + EPS) | (x["lo"] >= p["hi"] - EPS)
            sides = F.array(piece(p["lo"], F.least(x["lo"], p["hi"])), piece(F.greatest(x["hi"], p["lo"]), p["hi"]))
            return F.when(apart, F.array(p)).otherwise(F.filter(sides, lambda s: s["hi"] - s["lo"] > EPS))

        return F.flatten(F.transform(pieces, rest))

    return F.aggregate(b, a, cut)


def length(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x["hi"] - x["lo"])
