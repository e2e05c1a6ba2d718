"""SQL that solves small linear systems, for the oracles of regressions: sums of products and Gauss-Jordan elimination."""

from __future__ import annotations


def products(columns: dict[str, str], weight: str = "1", extra: str = "") -> str:
    """A select list of all sums of products of the named expressions, as p_a_b with a before b in order."""
    names = list(columns)
    parts = [f"sum(({weight}) * ({columns[a]}) * ({columns[b]})) AS p_{a}_{b}" for i, a in enumerate(names) for b in names[i:]]
    return ", ".join([*parts, *([extra] if extra else [])])


def dot(columns: list[str], a: str, b: str) -> str:
    """The name of a sum of products, whichever comes first."""
    return f"p_{a}_{b}" if columns.index(a) <= columns.index(b) else f"p_{b}_{a}"


def eliminate(name: str, source: str, matrix: list[list[str]], rhs: list[list[str]], keep: list[str] | None = None) -> str:
    """CTEs name0 .. name<k> that solve matrix * s = rhs row by row of ``source``; the last has s<i>_<m> and ``keep``."""
    k, m, kept = len(matrix), len(rhs[0]), "".join(f", {c}" for c in keep or [])
    out = [f"{name}0 AS (SELECT " + ", ".join([f"{matrix[i][j]} AS a{i}_{j}" for i in range(k) for j in range(k)] + [f"{rhs[i][c]} AS s{i}_{c}" for i in range(k) for c in range(m)]) + f"{kept} FROM {source})"]
    for p in range(k):
        cells = []
        for i in range(k):
            for old, new in [(f"a{i}_{j}", f"a{p}_{j}") for j in range(p + 1, k)] + [(f"s{i}_{c}", f"s{p}_{c}") for c in range(m)]:
                cells.append(f"{new} / a{p}_{p} AS {old}" if i == p else f"{old} - a{i}_{p} * {new} / a{p}_{p} AS {old}")
        out.append(f"{name}{p + 1} AS (SELECT {', '.join(cells)}{kept} FROM {name}{p})")
    return ", ".join(out)


def identity(k: int, first: list[list[str]] | None = None) -> list[list[str]]:
    """Right sides: ``first`` columns, then the unit matrix, which gives the inverse."""
    return [[*(first[i] if first else []), *("1.0::DOUBLE" if i == j else "0.0::DOUBLE" for j in range(k))] for i in range(k)]


def regression(name: str, source: str, columns: list[str], xs: list[str], y: str, keep: list[str] | None = None) -> str:
    """CTEs for least squares of y on xs from a source of ``products`` over ``columns``: s<i>_0 is beta, s<i>_<1+j> the inverse."""
    matrix = [[dot(columns, a, b) for b in xs] for a in xs]
    return eliminate(name, source, matrix, identity(len(xs), [[dot(columns, a, y)] for a in xs]), keep)
