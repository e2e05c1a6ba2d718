"""Reports of plans as one page of HTML with drawings; every figure and bar comes from an aggregate, so little reaches the driver.

Pages are made of text that is escaped here; they need nothing from elsewhere.
"""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.operators import scenario

#: The colours from low to high, and of the tones.
RAMP = ((214, 69, 65), (245, 176, 65), (39, 174, 96))
TONES = {"good": "#27ae60", "warn": "#f5b041", "bad": "#d64541", "info": "#13a0a0"}
#: For each score the shares from which it is good and fair.
GRADES = {"overall": (75.0, 50.0), "access": (75.0, 50.0), "balance": (99.9, 66.0), "adequacy": (90.0, 70.0)}
STATUS = {"Meets standard": "good", "Adequate": "good", "Deficit": "bad", "Overloaded": "bad", "Unused": "warn", "No standard": "info"}
#: Points that a map draws at most; more are thinned evenly.
MAP_POINTS = 4000
_STYLE = "body{font:14px sans-serif;margin:2em auto;max-width:64em;color:#234}h1{color:#0f6b6b}section{margin:1.5em 0}.cards{display:flex;gap:1em}.card{flex:1;border-top:4px solid;padding:.6em}.card b{font-size:2em;display:block}table{border-collapse:collapse;width:100%}td,th{padding:.3em .5em;border-bottom:1px solid #dde;text-align:left}td.n{text-align:right}.tag{color:#fff;padding:0 .5em;border-radius:.5em}"


def ramp_color(t: Column) -> Column:
    """The colour (#rrggbb) of a share between 0 and 1; NaN and null are 0."""
    s = F.least(F.greatest(F.when(t.isNull() | F.isnan(t), F.lit(0.0)).otherwise(t), F.lit(0.0)), F.lit(1.0)) * (len(RAMP) - 1)
    part = F.least(F.floor(s), F.lit(len(RAMP) - 2)).cast("int")
    at = lambda k, ch: F.element_at(F.array(*(F.lit(c[ch]) for c in RAMP)), part + 1 + k)
    mixed = [F.bround(at(0, ch) + (at(1, ch) - at(0, ch)) * (s - part), 0).cast("int") for ch in range(3)]
    return F.format_string("#%02x%02x%02x", *mixed)


def tone(value: Column, kind: str) -> Column:
    good, fair = GRADES[kind]
    return F.when(value.isNull(), "info").when(value >= good, "good").when(value >= fair, "warn").otherwise("bad")


def report_cards(access: DataFrame | None = None, balance: DataFrame | None = None, adequacy: DataFrame | None = None, density: DataFrame | None = None) -> DataFrame:
    """(k, label, value, sub, tone) of the summaries (``scenario``) that there are, the overall index first."""
    whole = lambda c: F.format_string("%.0f", F.col(c))
    percent = lambda c: F.coalesce(F.concat(whole(c), F.lit("%")), F.lit("n/a"))
    said = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    scored = [df for df in (access, balance, adequacy) if df is not None]
    parts = []
    if scored:
        parts.append((scenario.overall_score(access, balance, adequacy), F.col("overall").isNotNull(), "Plan Performance Index", whole("overall"), F.lit("mean of available components (0-100)"), tone(F.col("overall"), "overall")))
    if access is not None:
        parts.append((access, F.col("n") > 0, "Accessibility Score", whole("mean"), said(F.col("n").cast("string"), " origins - ", whole("share_full"), "% reach every category"), tone(F.col("mean"), "access")))
    if balance is not None:
        sub = F.when(F.col("n_deficit") > 0, said(F.col("n_deficit").cast("string"), " deficit(s) - worst: ", F.col("worst_category"))).otherwise(said(F.col("n_with_standard").cast("string"), " categories with a standard"))
        parts.append((balance, F.lit(True), "Standards Compliance", percent("compliance_pct"), sub, tone(F.col("compliance_pct"), "balance")))
    if adequacy is not None:
        parts.append((adequacy, F.lit(True), "Population Covered", percent("covered_share"), said(F.col("n_facilities").cast("string"), " facilities - ", F.col("n_overloaded").cast("string"), " overloaded"), tone(F.col("covered_share"), "adequacy")))
    if density is not None:
        rate = lambda c: F.concat(F.format_string("%.1f", F.col(c)), F.lit("/ha"))
        parts.append((density, F.col("n_cells") > 0, "Density (mean)", rate("mean"), said("max ", rate("max"), " over ", F.col("n_cells").cast("string"), " cells"), F.lit("info")))
    if not parts:
        raise ValueError("no summary")
    rows = [df.where(there).select(F.lit(k).alias("k"), F.lit(label).alias("label"), value.alias("value"), sub.alias("sub"), t.alias("tone")) for k, (df, there, label, value, sub, t) in enumerate(parts)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# drawings


def _svg(width: float, height: float, parts: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}" role="img">{"".join(parts)}</svg>'


def _box(x: float, y: float, w: float, h: float, fill: str) -> str:
    return f'<rect x="{x:.1f}" y="{y:.1f}" width="{max(w, 0):.1f}" height="{max(h, 0):.1f}" fill="{fill}"/>'


def _word(x: float, y: float, text: str, anchor: str = "start", size: int = 10) -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" font-size="{size}" text-anchor="{anchor}">{escape(text)}</text>'


def histogram(values: DataFrame, value: str = "value", low: float = 0.0, high: float = 100.0, bins: int = 10) -> DataFrame:
    """(bin, n, color): all bins between low and high; values beyond them count in the first and last one."""
    k = F.least(F.greatest(((F.col(value) - low) / ((high - low) or 1.0) * bins).cast("int"), F.lit(0)), F.lit(bins - 1))
    counts = values.where(F.col(value).isNotNull()).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), ramp_color((F.col("bin") + 0.5) / bins).alias("color"))


def svg_histogram(values: DataFrame, value: str = "value", low: float = 0.0, high: float = 100.0, bins: int = 10, width: int = 460, height: int = 150) -> str:
    rows = histogram(values, value, low, high, bins).orderBy("bin").collect()
    most, step, floor = max((r["n"] for r in rows), default=0) or 1, width / bins, height - 16
    parts = []
    for r in rows:
        tall = (floor - 14) * r["n"] / most
        parts.append(_box(r["bin"] * step + 1, floor - tall, step - 2, tall, r["color"]))
        if r["n"]:
            parts.append(_word((r["bin"] + 0.5) * step, floor - tall - 3, str(r["n"]), "middle"))
    return _svg(width, height, [*parts, _word(2, height - 4, f"{low:g}"), _word(width - 2, height - 4, f"{high:g}", "end")])


def map_points(points: DataFrame, low: float = 0.0, high: float = 100.0, most: int = MAP_POINTS) -> DataFrame:
    """(x, y, color) of points (x, y, value), thinned evenly (by a hash of their place) to about ``most`` of them: a drawing has room for so many."""
    n = points.count()
    keep = F.lit(True) if n <= most else F.pmod(F.xxhash64("x", "y", "value"), F.lit(n)) < most
    return points.where(keep).select("x", "y", ramp_color((F.col("value") - low) / ((high - low) or 1.0)).alias("color"))


def svg_point_map(points: DataFrame, low: float = 0.0, high: float = 100.0, width: int = 460, height: int = 340) -> str:
    """A map of points (x, y, value); nothing without points."""
    rows = map_points(points, low, high).limit(2 * MAP_POINTS).collect()
    if not rows:
        return ""
    x, y, edge = [r["x"] for r in rows], [r["y"] for r in rows], 10
    zoom = min((width - 2 * edge) / ((max(x) - min(x)) or 1.0), (height - 2 * edge) / ((max(y) - min(y)) or 1.0))
    size = max(2.0, min(6.0, 90 / len(rows) ** 0.5))
    dots = [f'<circle cx="{edge + (r["x"] - min(x)) * zoom:.1f}" cy="{edge + (max(y) - r["y"]) * zoom:.1f}" r="{size:.1f}" fill="{r["color"]}"/>' for r in rows]
    return _svg(width, height, [_box(0, 0, width, height, "#f6f8f8"), *dots])


def svg_balance_bars(rows: DataFrame, width: int = 560, bar: int = 14) -> str:
    """What there is and what is asked for of each category (category, area_m2, required_m2, status) with a standard."""
    found = rows.where("status <> 'No standard'").orderBy("category").limit(1000).collect()
    most = max((max(r["area_m2"], r["required_m2"]) for r in found), default=0) or 1.0
    parts, left = [], 160
    for k, r in enumerate(found):
        y = k * (2 * bar + 12)
        parts.append(_word(0, y + bar, r["category"], size=11))
        for j, (v, fill) in enumerate(((r["area_m2"], TONES["bad" if r["status"] == "Deficit" else "good"]), (r["required_m2"], "#b0bec5"))):
            long = (width - left - 70) * v / most
            parts += [_box(left, y + j * bar, long, bar - 2, fill), _word(left + long + 4, y + (j + 1) * bar - 4, f"{v:,.0f} m2" + (" req." if j else ""))]
    return _svg(width, len(found) * (2 * bar + 12) + 4, parts) if found else ""


def svg_pyramid(rows: DataFrame, width: int = 460, bar: int = 16, names: tuple[str, str] = ("now", "horizon")) -> str:
    """Bars of (k, label, start, end) in order of k: the start grey, the end green where it grows and red where it shrinks."""
    found = rows.orderBy("k").limit(1000).collect()
    most, left, parts = max((max(r["start"], r["end"]) for r in found), default=0) or 1.0, 90, []
    for k, r in enumerate(found):
        y, scale = k * (bar + 6), (width - left - 70) / most
        parts += [_word(0, y + bar - 4, str(r["label"]), size=11), _box(left, y, r["start"] * scale, bar - 4, "#b0bec5"), _box(left, y + 4, r["end"] * scale, bar - 6, TONES["good" if r["end"] >= r["start"] else "bad"])]
        parts.append(_word(left + max(r["start"], r["end"]) * scale + 4, y + bar - 4, f"{r['end']:,.0f}"))
    height = len(found) * (bar + 6) + 18
    return _svg(width, height, [*parts, _word(left, height - 4, f"grey = {names[0]}, coloured = {names[1]}")])


# pages


def _figure(v) -> str:
    if v is None:
        return "-"
    return f"{int(v):,}" if float(v) == int(v) and abs(v) < 1e9 else f"{float(v):,.2f}"


def _tag(status: str) -> str:
    return f'<span class="tag" style="background:{TONES[STATUS.get(status, "info")]}">{escape(status)}</span>'


def _grid(head: list[str], rows: list[list[str]]) -> str:
    return "<table><tr>" + "".join(f"<th>{escape(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(r) + "</tr>" for r in rows) + "</table>"


def _cell(text: str, number: bool = True, style: str = "") -> str:
    return f'<td{" class=n" if number else ""}{f" style={chr(34)}{style}{chr(34)}" if style else ""}>{text}</td>'


def _page(title: str, about: str, parts: list[str]) -> str:
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{_STYLE}</style></head><body><h1>{escape(title)}</h1><p>{escape(about)}</p>{''.join(parts)}</body></html>"


def compare_section(rows: DataFrame, a: str = "A", b: str = "B") -> str:
    """A table of (metric, a, b, delta, better): both values, how they differ and who is better."""
    lines = []
    for r in rows.orderBy("metric").limit(10_000).collect():
        fill = "#90a4ae" if r["delta"] is None or r["better"] not in ("A", "B") else TONES["good" if r["better"] == "B" else "bad"]
        arrow = "" if r["better"] not in ("A", "B") or r["delta"] is None else ("&#9650; " if r["delta"] > 0 else "&#9660; ")
        change = "-" if r["delta"] is None else f"{arrow}{r['delta']:+,.2f}" + (f" ({100 * r['delta'] / abs(r['a']):+.1f}%)" if r["a"] else "")
        name = scenario.METRICS.get(r["metric"], (r["metric"].replace("_", " ").title(),))[0]
        lines.append([_cell(escape(name), False), _cell(_figure(r["a"])), _cell(_figure(r["b"])), _cell(change, style=f"color:{fill}"), _cell(escape({"A": a, "B": b, "tie": "tie"}.get(r["better"], "-")), False)])
    return "<section><h2>Comparison</h2>" + _grid(["Metric", a, b, f"{b} - {a}", "Better"], lines) + "</section>"


def compare_html(title: str, rows: DataFrame, a: str = "A", b: str = "B", verdict: str = "", generated: str = "") -> str:
    said = f"<section><p>{escape(verdict)}</p></section>" if verdict else ""
    return _page(title, f"{a} and {b} {generated}".strip(), [said, compare_section(rows, a, b)])


def rank_html(title: str, ranking: DataFrame, values: DataFrame | None = None, note: str = "", generated: str = "") -> str:
    """A page of (name, score, rank) and, with them, of values (metric, name, value, norm) by colour."""
    lead = ranking.select("name", "score", "rank", ramp_color(F.col("score") / 100).alias("color")).orderBy("rank", "name").limit(1000).collect()
    bars = [[_cell(str(r["rank"])), _cell(escape(r["name"]), False), _cell(f"{r['score']:.1f}"), _cell(_svg(300, 14, [_box(0, 0, 3 * r["score"], 14, r["color"])]), False)] for r in lead]
    parts = ["<section><h2>Ranking</h2>" + _grid(["Rank", "Scenario", "Score", ""], bars) + "</section>"]
    if values is not None:
        cells: dict[str, dict[str, str]] = {}
        for r in values.withColumn("color", ramp_color(F.col("norm"))).limit(100_000).collect():
            cells.setdefault(r["metric"], {})[r["name"]] = _cell(_figure(r["value"]), style=f"background:{r['color']};color:#fff")
        names = [r["name"] for r in lead]
        rows = [[_cell(escape(scenario.METRICS.get(m, (m,))[0]), False), *(own.get(n, _cell("-")) for n in names)] for m, own in sorted(cells.items())]
        parts.append("<section><h2>Metrics</h2>" + _grid(["Metric", *names], rows) + "</section>")
    return _page(title, generated, [*parts, f"<p>{escape(note)}</p>" if note else ""])


def plan_html(title: str, scores: DataFrame | None = None, balance: DataFrame | None = None, facilities: DataFrame | None = None, demand: DataFrame | None = None, densities: DataFrame | None = None, population: float | None = None, generated: str = "") -> str:
    """A page of what there is: scores (score[, x, y]), balance rows, facilities with demand, densities (value)."""
    access = scenario.access_summary(scores) if scores is not None else None
    standards = scenario.balance_summary(balance) if balance is not None else None
    adequacy = scenario.adequacy_summary(facilities, demand) if facilities is not None and demand is not None else None
    density = scenario.density_summary(densities) if densities is not None else None
    cards = report_cards(access, standards, adequacy, density).orderBy("k").collect()
    parts = ['<div class="cards">' + "".join(f'<div class="card" style="border-color:{TONES[c["tone"]]}">{escape(c["label"])}<b>{escape(c["value"])}</b>{escape(c["sub"])}</div>' for c in cards) + "</div>"]
    if access is not None and (s := access.first())["n"]:
        text = f"{s['n']} origins: mean {s['mean']:.1f}, median {s['median']:.1f}; {s['share_full']:.1f}% reach everything, {s['share_low']:.1f}% score below 50."
        drawn = svg_histogram(scores, "score") + (svg_point_map(scores.select("x", "y", F.col("score").alias("value"))) if {"x", "y"} <= set(scores.columns) else "")
        parts.append(f"<section><h2>Accessibility</h2><p>{escape(text)}</p>{drawn}</section>")
    if balance is not None:
        rows = balance.orderBy("category").limit(10_000).collect()
        lines = [[_cell(escape(r["category"]), False), *(_cell(f"{r[c]:,.0f}") for c in ("area_m2", "required_m2", "balance_m2")), _cell(_tag(r["status"]), False)] for r in rows]
        parts.append("<section><h2>Land use and standards</h2>" + svg_balance_bars(balance) + _grid(["Category", "m2", "Required m2", "Balance m2", "Status"], lines) + "</section>")
    if adequacy is not None:
        s = adequacy.first()
        share = "n/a" if s["covered_share"] is None else f"{s['covered_share']:.1f}%"
        rows = facilities.orderBy(F.col("utilization").desc()).limit(10_000).collect()
        lines = [[_cell(escape(str(r["facility"])), False), *(_cell(f"{r[c]:,.2f}") for c in ("capacity", "assigned", "utilization")), _cell(_tag(r["status"]), False)] for r in rows]
        parts.append(f"<section><h2>Facilities</h2><p>{share} of the population covered; {s['n_overloaded']} of {s['n_facilities']} overloaded, {s['n_unused']} unused.</p>" + _grid(["Facility", "Capacity", "Assigned", "Utilization", "Status"], lines) + "</section>")
    if density is not None and (s := density.first())["n_cells"]:
        parts.append(f"<section><h2>Density</h2><p>{s['n_cells']} cells: mean {s['mean']:.1f}, largest {s['max']:.1f} a hectare.</p></section>")
    return _page(title, " - ".join(x for x in (generated, f"planned population {population:,.0f}" if population else "") if x), parts)
