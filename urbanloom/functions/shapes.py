"""Building footprints by their width and depth, as rings of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For each shape its sizes (the larger of a least size and a share of w, h or the smaller of them) and its outline as
#: "x,y" corners over w, h and the sizes. The least sizes and shares.
SHAPES = {
    "rectangle": ({"b": (5.0, "w", 0.9)}, "(w-b)/2,0 (w+b)/2,0 (w+b)/2,h (w-b)/2,h (w-b)/2,0"),
    "L": ({"m": (7.0, "w", 0.45), "t": (7.0, "h", 0.4)}, "0,0 w,0 w,t m,t m,h 0,h 0,0"),
    "U": ({"m": (7.0, "w", 0.3), "t": (7.0, "h", 0.3)}, "0,0 w,0 w,h w-m,h w-m,t m,t m,h 0,h 0,0"),
    "T": ({"m": (7.0, "w", 0.4), "t": (7.0, "h", 0.35)}, "0,h-t w,h-t w,h 0,h 0,h-t (w-m)/2,h-t (w-m)/2,0 (w+m)/2,0 (w+m)/2,h-t w,h-t"),
    "H": ({"m": (7.0, "w", 0.3), "t": (7.0, "h", 0.3)}, "0,0 m,0 m,(h-t)/2 w-m,(h-t)/2 w-m,0 w,0 w,h w-m,h w-m,(h+t)/2 m,(h+t)/2 m,h 0,h 0,0"),
    "courtyard": ({}, "0,0 w,0 w,h 0,h 0,0"),
    "C": ({"m": (7.0, "w", 0.4), "t": (7.0, "h", 0.25)}, "0,0 w,0 w,t m,t m,h-t w,h-t w,h 0,h 0,0"),
    "E": ({"m": (7.0, "w", 0.25), "t": (7.0, "h", 0.2)}, "0,0 w,0 w,t m,t m,(h-t)/2 w,(h-t)/2 w,(h+t)/2 m,(h+t)/2 m,h-t w,h-t w,h 0,h 0,0"),
    "cross": ({"m": (7.0, "w", 0.35), "t": (7.0, "h", 0.35)}, "(w-m)/2,0 (w+m)/2,0 (w+m)/2,(h-t)/2 w,(h-t)/2 w,(h+t)/2 (w+m)/2,(h+t)/2 (w+m)/2,h (w-m)/2,h (w-m)/2,(h+t)/2 0,(h+t)/2 0,(h-t)/2 (w-m)/2,(h-t)/2 (w-m)/2,0"),
}
#: A courtyard's wall, and the outline of what it leaves open.
_WALL, _COURT = (7.0, "least", 0.25), "m,m w-m,m w-m,h-m m,h-m m,m"


def _ring(outline: str, names: dict[str, str]) -> Column:
    def value(term: str) -> str:
        return "(" + "".join(names.get(x, x) for x in term) + ")"

    points = [p.split(",") for p in outline.split()]
    return F.array(*(F.expr(f"struct(cast({value(x)} as double) as x, cast({value(y)} as double) as y)") for x, y in points))


def _sizes(sizes: dict[str, tuple], w: str, h: str, shares: dict[str, float]) -> dict[str, str]:
    side = {"w": f"`{w}`", "h": f"`{h}`", "least": f"least(`{w}`, `{h}`)"}
    names = {"w": side["w"], "h": side["h"]}
    return names | {k: f"greatest({least}D, {side[of]} * {float(shares.get(k, share))}D)" for k, (least, of, share) in sizes.items()}


def footprint(shape: str, w: str = "w", h: str = "h", **shares: float) -> Column:
    """The outline (array<struct<x, y>>, closed) of one of SHAPES in a box of the columns ``w`` by ``h``; ``shares`` replace
    the shares of its sizes (m across, t along, b a rectangle's breadth)."""
    sizes, outline = SHAPES[shape]
    return _ring(outline, _sizes(sizes, w, h, shares))


def courtyard(w: str = "w", h: str = "h", wall: float = _WALL[2]) -> Column:
    """The ring of the open court within a courtyard's outline."""
    return _ring(_COURT, _sizes({"m": _WALL}, w, h, {"m": wall}))
