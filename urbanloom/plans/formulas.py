"""One query for each formula of the catalog, on the relation ``plots``, and its SQL, written by itself."""

from __future__ import annotations

import re

from urbanloom.functions.formulas import FORMULAS, apply, text
from urbanloom.plans.registry import query

R = lambda x: f"round({x}, 6) + 0.0"


def graded(score: str, *steps: tuple[float, str], last: str) -> str:
    """The name of the first step that a score reaches, by an array of the names of those below."""
    names = [last, *(n for _, n in reversed(steps))]
    reached = " + ".join(f"({score} >= {at})::INT" for at, _ in steps)
    return f"[{', '.join(repr(n) for n in names)}][1 + {reached}]"


def part(x: str) -> str:
    return f"least(1, greatest(0, {x}))"


RISK = ((75, "Very High"), (55, "High"), (35, "Moderate"))
#: For each formula the CTEs over plots (p) that its columns are taken from, and the columns.
SQL: dict[str, tuple[str, dict[str, str]]] = {}


def own(name: str, steps: str = "", **columns: str) -> None:
    SQL[name] = (steps, columns)


def number(**columns: str) -> dict[str, str]:
    return {k: R(f"({v})::DOUBLE") for k, v in columns.items()}


own("composite_risk_class", **{"class": graded("u * 100", *RISK, last="Low")})
own("accessibility_deficit_class", **{"class": graded("u * 100", (75, "Critical"), (55, "Underserved"), (35, "Watch"), last="Covered")})
own("intervention_priority_class", **{"class": graded("u * 100", (75, "Immediate"), (55, "High"), (35, "Medium"), last="Monitor")})
own("class_of", **{"class": "1 + (s > 5)::INT + (s > 8)::INT + (s > 12)::INT"})

# heat
own("urban_heat_comfort_risk", f", c AS (SELECT id, least(100, greatest(0, 30 * u + 25 * v + 0.3 * (50 * (1 - w) + 50 * {part('s / 20')}) + 0.15 * 100 * {part('q * 1.2')})) AS x FROM p)", **number(score="x"), **{"class": graded("x", *RISK, last="Low")})
own("urban_heat_island_intensity", **number(uhi=f"greatest(0, 2 + 3 * (1 - u) + 4 - 6 * v + 4 * {part('s * w / 30')} - least(2, ln(1 + q * 8)))"))
own("local_climate_zone", f"""
, z AS (SELECT id, [CASE WHEN u >= 0.4 THEN 3 - (s >= 10)::INT - (s > 25)::INT WHEN u >= 0.2 THEN 6 - (s >= 10)::INT - (s > 25)::INT ELSE 11 END, CASE WHEN u >= 0.2 AND u < 0.4 AND s BETWEEN 3 AND 15 AND v >= 0.5 THEN 8 END, CASE WHEN u >= 0.4 AND s BETWEEN 3 AND 10 AND v < 0.3 THEN 7 END, CASE WHEN u >= 0.2 AND u < 0.4 AND s BETWEEN 5 AND 15 AND v >= 0.7 THEN 10 END, CASE WHEN u >= 0.05 AND u < 0.2 AND s BETWEEN 3 AND 15 THEN 9 END] AS z FROM p)""", lcz="list_filter(z, lambda x: x IS NOT NULL)[-1]")
own("surface_cool_island", ", c AS (SELECT id, u, greatest(0, v - u) * 40 + 3 * w AS c FROM p)", **number(cooling="c", surface="50 - 15 * u - c", pet_gain="c * 3 / 5"))
own("wind_canopy_drag", ", c AS (SELECT id, 1 + u * 14 AS i, (1 + u * 14) * exp(-0.1 * v * 5 - 0.25 * w) * 0.75 AS x FROM p)", **number(speed="x", loss=part("1 - x / i")), **{"class": "1 + (x >= 1.8)::INT + (x >= 3.6)::INT + (x >= 5.3)::INT + (x >= 7.6)::INT"})
own("heatwave_vulnerability", """
, f AS (SELECT *, 20 + u * 20 AS t, (20 + u * 20) * 9 / 5 + 32 AS f, 30 + v * 60 AS h FROM p), h AS (SELECT *, CASE WHEN t < 25 THEN t ELSE (-42.379 + 2.04901523 * f + 10.14333127 * h - 0.22475541 * f * h - 0.00683783 * f ** 2 - 0.05481717 * h ** 2 + 0.00122874 * f ** 2 * h + 0.00085282 * f * h ** 2 - 0.00000199 * f ** 2 * h ** 2 - 32) * 5 / 9 END AS x FROM f)""", **number(heat_index="x", score="x / 40 * (1 + w) * (2 - q)"))
own("heat_risk_index", **number(score=f"least(100, greatest(0, 100 * (0.4 * u + 0.2 * {part('s / 20')} - 0.3 * v - 0.1 * w + 0.3) / 0.9))"))
own("building_solar_radiation", **number(irradiation="12000 * s * u", **{"yield": "2160 * s * u"}))
own("clear_sky_irradiance", ", d AS (SELECT id, sin(radians(1 + u * 89)) AS h, 2 * pi() / 365 * (1 + floor(v * 364)) AS a, 2 * pi() / 365 AS o FROM p), e AS (SELECT *, (1160 + 75 * sin(a - 275 * o)) * exp(-(0.174 + 0.035 * sin(a - 100 * o)) / h) AS b FROM d)", **number(beam="b * h", diffuse="b * (0.095 + 0.04 * sin(a - 100 * o))"))
own("thermal_comfort_pet", ", m AS (SELECT *, 10 + u * 30 AS t, 0.07 * q * 900 * (1 - w) * v AS d FROM p)", **number(pet="least(60, greatest(-10, t + d * (0.344 - 0.05 * greatest(0.1, w * 8)) + 0.07 * 6.11 * pow(10, 7.5 * t / (237.3 + t)) * (0.3 + 0.6 * v)))"))
own("albedo_cooling_potential", **number(drop="greatest(0, 0.45 - u) * 160 / 3"))

# water
runoff = lambda rain, cn: f"CASE WHEN {rain} > 5080 / ({cn}) - 50.8 THEN pow({rain} - 5080 / ({cn}) + 50.8, 2) / ({rain} + 20320 / ({cn}) - 203.2) ELSE 0 END"
own("scs_runoff", **number(runoff=runoff("(s * 3)", "40 + u * 59")))
own("pluvial_flash_flood", f", q AS (SELECT id, {runoff('(s * 3)', '40 + u * 59')} AS q FROM p)", **number(runoff="q", ponding="greatest(0, q - 25)"))
own("detention_basin", f", q AS (SELECT id, s, {runoff('(30 + w * 90)', '40 + u * 30')} AS a, {runoff('(30 + w * 90)', '70 + v * 29')} AS b FROM p)", **number(depth="greatest(0, b - a)", volume="greatest(0, b - a) * s * 10", peak="0.00208 * s * b / 3.6"))
own("retention_basin", ", b AS (SELECT id, (0.05 + 0.9 * u) * (20 + v * 60) * s * 12 AS vol, (2 + w * 20) * 0.048 AS d FROM p)", **number(volume="vol", depth="d", basin_area="vol / d"))
own("green_roof_retention", **number(retained="0.78 * s * u"))
own("socio_economic_flood_risk", ", h AS (SELECT id, s AS a, u + price / 1000 AS b, v AS c FROM p), e AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(c) AS c0, max(c) AS c1 FROM h), x AS (SELECT id, 100 * (a - a0) / (a1 - a0) * (b - b0) / (b1 - b0) * (c - c0) / (c1 - c0) AS x FROM h, e)", **number(score="x"), **{"class": graded("x", (75, "Very High"), (50, "High"), (25, "Moderate"), last="Low")})

# ground and fire
own("slope_stability", ", a AS (SELECT *, radians(least(89, greatest(0.1, u * 60))) AS a FROM p), f AS (SELECT id, (v * 20 + 60 * cos(a) ** 2 * tan(radians(20 + w * 20))) / (60 * cos(a) * (sin(a) + q * 0.5 * cos(a)) + 1e-12) AS f FROM a)", **number(safety="f"), unstable="f < 1")
own("compound_hazard_risk", **number(risk=f"(1 - (1 - {part('u * 1.5')}) * (1 - {part('(v * 30 - 5) / 20')}) * (1 - {part('w * 1.6')})) * 100 * s / ((SELECT max(s) FROM p) + 1e-6)"))
own("wildfire_front", ", r AS (SELECT id, (0.5 + 6 * u) * (1 + 0.05 * tan(radians(v * 45))) * (1 + 1.2 * u) AS r, 0.5 + w * 5 AS h FROM p)", **number(rate="r", forward="r * 60 * h", flank="r * 24 * h", buffer="r * 90 * h"))
own("magnitude_factor", **number(factor="exp(0.8 * (u * 4 - 2))"))
own("collapse_probability", ", b AS (SELECT id, v, [0.85, 0.6, 0.25, 0.05][1 + (y > 1985)::INT + (y > 2000)::INT + (y > 2018)::INT] AS b FROM (SELECT id, v, 1960 + floor(u * 65) AS y FROM p))", **number(base="b", p=part("b * exp(0.8 * (v * 4 - 2))")))
own("debris_extent", **number(reach="(v > 0.5)::INT * s * 0.4", volume="(v > 0.5)::INT * u * 900 * s * 0.3"))
own("road_blockage", ", r AS (SELECT id, v, s / (6 + u * 50) AS r FROM p), c AS (SELECT id, r, v * least(r, 1) AS x FROM r)", **number(p="x"), state="['open', 'restricted', 'blocked', 'blocked'][1 + greatest((x >= 0.3)::INT + (x >= 0.7)::INT, 3 * (r >= 1)::INT)]")

# air and noise
own("road_emission", **number(emission="400 * s * u"))
own("air_sample_strength", **number(strength="2500 * s * greatest(u * 50, 1e-6) / pi()"))
own("canyon_factor", **number(factor="least(3, 1 + s / (5 + u * 30))"))
own("noise_emission", **number(level="37.3 + 10 * (log10(s * 30) + log10(1 + 0.082 * u * 30))"))
own("noise_sample_level", **number(level="50 + u * 30 + 10 * (log10(25 / pi()) + log10(greatest(s, 1e-6)))"))

# streets
own("level_of_traffic_stress", ", x AS (SELECT id, 20 + s AS k, 1 + floor(u * 5) AS l, v > 0.5 AS b, w > 0.5 AS f, q * 12000 AS t FROM p), c AS (SELECT id, k <= 30 AND l <= 2 AND f AND (t <= 3000 OR b) AS a, k <= 40 AND l <= 2 AND (b OR f) AS b, k <= 50 AND ((b AND l <= 4) OR (l <= 2 AND t <= 8000)) AS c FROM x)", lts="list_position([a, b, c, true], true)")
own("lts_by_infrastructure", ", x AS (SELECT id, CAST(floor(u * 3) AS INT) AS k, 20 + s AS v, 1 + floor(v * 4) AS l, w * 4000 AS t FROM p)", lts="[1, 3 - (v <= 50 AND l <= 3)::INT, 4 - (v <= 50)::INT - (v <= 30 AND l <= 2)::INT - (v <= 30 AND l <= 2 AND t < 1000)::INT][k + 1]")
own("wind_comfort_lawson", ", r AS (SELECT id, v, s / (5 + u * 30) AS r FROM p), f AS (SELECT id, CASE WHEN r > 1.5 THEN 1.2 + 0.2 * least(3, r) ELSE 0.8 + r / 5 END AS f, 1 + v * 6 AS a FROM r)", **number(factor="f", speed="f * a"), **{"class": "['Sitting', 'Standing', 'Strolling', 'Business Walking', 'Uncomfortable'][1 + (f * a >= 1.8)::INT + (f * a >= 3.6)::INT + (f * a >= 5.3)::INT + (f * a >= 7.6)::INT]"})
own("pedestrian_level_of_service", f", x AS (SELECT id, 6 * (0.4 * {part('(0.5 + u * 4) / 3')} + 0.3 * (1 - {part('(1 + floor(w * 5)) * (20 + s) / 300')}) + 0.3 * {part('1 - v * 80 / 75')}) AS x FROM p)", **number(score="x"), grade=graded("x", (5, "A"), (4, "B"), (3, "C"), (2, "D"), (1, "E"), last="F"))
own("route_directness", **number(directness="coalesce(s * 20 / nullif(greatest(u * 700, 0), 0), 1)"))
own("tobler_speed", **number(speed="6 * exp(-3.5 * abs(u - 0.45))"))
own("bpr_travel_time", **number(time="(1 + v * 20) + 0.15 * (1 + v * 20) * pow(s * 40 / (500 + u * 1500), 4)"))
own("linear_score", **number(score="least(100, greatest(0, (s - 5) * 100 / 35))"))
own("kernel_weight", **number(weight="(s <= 30)::INT * exp(-s * s / 200)"))

# plots, people, prices
own("spacemate", ", g AS (SELECT id, u * 4 AS f, v AS g0, least(1, greatest(0.0001, v)) AS g FROM p)", **number(osr="(1 - g) / greatest(f, 0.0001)", layers="f / g"), type="CASE WHEN f > 2 THEN CASE WHEN g0 > 0.4 THEN 'High-Density Courtyard' ELSE 'High-Rise Tower Block' END WHEN f <= 1 AND g0 <= 0.3 THEN 'Low-Density Suburban' WHEN g0 > 0.5 THEN 'Mid-Rise Dense Block' ELSE 'Open Urban Fabric' END")
own("solar_envelope_volume", **number(volume="greatest(0, 4 + s) * greatest(0, 4 + u * 40) * 15 * 0.85"))
own("trip_generation", **number(productions="150 * s", attractions="6000 * u"))
own("housing_needs", **number(households="s * 100 / 2.4", need="s * 105 / 2.4 - u * 2000 + greatest(v * 50, 0)"))
own("residential_capacity", ", b AS (SELECT id, greatest(0, s * 300 * u - v * 4000) AS b FROM p)", **number(buildable="b", units="floor(b * 0.85 / 90)"))
own("transit_premium", ", x AS (SELECT id, price, 0.6 * exp(-3.75 * u) + 0.4 * exp(-3 * v) AS x FROM p)", **number(score="100 * x", premium="0.15 * price * x"))
own("cap_rate", **number(years="10 / nullif(u, 0)", value="coalesce(10 * price / nullif(u, 0), 0)"))
own("carbon_sequestration", ", b AS (SELECT id, 0.15 * exp(2.3 * ln(s)) AS b FROM p)", **number(biomass="b", carbon="b / 2", annual="b * 0.0175"))
own("equity_adjusted_priority", ", x AS (SELECT id, least(100, greatest(0, 100 * u * (1 + v / 2) / 1.5)) AS x FROM p)", **number(score="x"), **{"class": graded("x", *RISK, last="Low")})
own("energy_vulnerability", **number(score="35 * (1 - price / (SELECT max(price) FROM p)) + 30 * (1 - u) + 20 * v + 15 * w"))
own("equity_weighted_accessibility", **number(weighted="s * (0.1 + u) / (SELECT avg(0.1 + u) FROM p)"))
own("tod_node_suitability", **number(score="25 * s / (SELECT max(s) FROM p) + 25 * price / (SELECT max(price) FROM p) + 20 * u + 20 * v + 10 * exp(-greatest(0, w - 0.2) / 2)"))
own("micromobility_score", **number(score="s / (0.200001 + v) * exp(-4 * u)"))
own("meshedness", ", n AS (SELECT id, 3 + s AS n, 3 + s * (1 + u) AS e FROM p)", **number(alpha="(e - n + 1) / (2 * n - 5)", beta="e / n", gamma="e / (3 * n - 6)"))


def _register(name: str) -> None:
    f = FORMULAS[name]
    inputs = [f"CAST({sql} AS DOUBLE) AS i_{x}" for x, sql in f.sample.items()]
    out = text(name, str, {}, lambda k, x: x)
    steps, columns = SQL[name]
    last = ["p", *re.findall(r"(?:^|\), |\n, |^, )(\w) AS \(SELECT", steps)][-1]
    picked = ", ".join(f'{v} AS "{k}"' for k, v in columns.items())
    query(name, lambda p: apply(p.selectExpr("id", *inputs), name, {x: f"i_{x}" for x in f.sample}).select("id", *out), "plots", sql=f"WITH p AS (SELECT * FROM {{plots}}){steps} SELECT id, {picked} FROM {last}")


for _name in FORMULAS:
    _register(_name)
