"""A catalog of row-wise planning formulas: each is a set of SQL expressions over named inputs and parameters.

``apply`` adds a formula's outputs to a DataFrame. ``{x}`` stands for an input column or a parameter; ``{lo:x}``,
``{hi:x}``, ``{avg:x}`` and ``{sum:x}`` for that column's extreme, mean or sum over all rows, which is one aggregate of
one row that is broadcast. Everything stays in generated code; a null input gives a null output.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"lo": "min", "hi": "max", "avg": "avg", "sum": "sum"}


@dataclass(frozen=True)
class Formula:
    doc: str
    out: dict[str, str]
    #: Expressions over the relation ``plots`` that the query uses as inputs.
    sample: dict[str, str]
    params: dict[str, float] = field(default_factory=dict)


def _tiers(x: str, *steps, last: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {at} THEN '{name}'" for at, name in steps) + f" ELSE '{last}' END"


def _clip(x: str, lo: float, hi: float) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


_RUNOFF = "CASE WHEN {rain} > 0.2 * (25400.0 / {cn} - 254.0) THEN pow({rain} - 0.2 * (25400.0 / {cn} - 254.0), 2) / ({rain} + 0.8 * (25400.0 / {cn} - 254.0)) ELSE 0.0 END"
_TF = "({t} * 1.8 + 32.0)"
#: The regression of the heat index on temperature (F) and relative humidity.
_HEAT_INDEX_F = f"(-42.379 + 2.04901523 * {_TF} + 10.14333127 * {{rh}} - 0.22475541 * {_TF} * {{rh}} - 0.00683783 * {_TF} * {_TF} - 0.05481717 * {{rh}} * {{rh}} + 0.00122874 * {_TF} * {_TF} * {{rh}} + 0.00085282 * {_TF} * {{rh}} * {{rh}} - 0.00000199 * {_TF} * {_TF} * {{rh}} * {{rh}})"
_HEAT_INDEX = f"(CASE WHEN {{t}} < 25.0 THEN {{t}} ELSE ({_HEAT_INDEX_F} - 32.0) / 1.8 END)"
_UHI = "greatest({base} + 3.0 * (1.0 - {albedo}) + 4.0 * (1.0 - least(greatest(({ndvi} + 1.0) / 2.0, 0.0), 1.0)) - 2.0 * least(greatest(({ndvi} + 1.0) / 2.0, 0.0), 1.0) + 4.0 * least(greatest({height} * {footprint} / 30.0, 0.0), 1.0) - least(ln(1.0 + greatest({wind}, 0.0)), 2.0), 0.0)"
_COMFORT = _clip("(100.0 * {impervious} * {w_imperv} + 100.0 * {built} * {w_build} + 0.5 * (100.0 * (1.0 - {green}) + " + _clip("{cooling} / {reach} * 100.0", 0.0, 100.0) + ") * {w_green} + " + _clip("{vulnerable} * 20.0", 0.0, 100.0) + " * {w_vuln}) / ({w_imperv} + {w_build} + {w_green} + {w_vuln})", 0.0, 100.0)
_FS = "({cohesion} + {weight} * pow(cos(radians(" + _clip("{slope}", 0.1, 89.0) + ")), 2) * tan(radians({friction}))) / ({weight} * sin(radians(" + _clip("{slope}", 0.1, 89.0) + ")) * cos(radians(" + _clip("{slope}", 0.1, 89.0) + ")) + {pga} * {weight} * pow(cos(radians(" + _clip("{slope}", 0.1, 89.0) + ")), 2) + 1e-12)"
_COMPOUND = "(1.0 - (1.0 - " + _clip("{depth} / 2.0", 0.0, 1.0) + ") * (1.0 - " + _clip("({heat} - 25.0) / 20.0", 0.0, 1.0) + ") * (1.0 - " + _clip("{pga} / 0.5", 0.0, 1.0) + ")) * {exposure} / ({hi:exposure} + 1e-6) * 100.0"
_PED = "{inflow} * exp(-0.5 * ({drag} * {lai} + 0.5 * {frontal})) * 0.75"
_AMP = "(CASE WHEN {height} / {width} > 1.5 THEN 1.2 + 0.2 * least({height} / {width}, 3.0) ELSE 0.8 + 0.2 * {height} / {width} END)"
_LAWSON = "CASE WHEN {0} < 1.8 THEN 'Sitting' WHEN {0} < 3.6 THEN 'Standing' WHEN {0} < 5.3 THEN 'Strolling' WHEN {0} < 7.6 THEN 'Business Walking' ELSE 'Uncomfortable' END"
_PLOS = "(0.4 * " + _clip("{width} / 3.0", 0.0, 1.0) + " + 0.3 * (1.0 - " + _clip("{lanes} * {speed} / 300.0", 0.0, 1.0) + ") + 0.3 * " + _clip("1.0 - {flow} / 75.0", 0.0, 1.0) + ") * 6.0"
_RATIO = "{height} * {factor} / greatest({width}, 1.0)"
_PRIORITY = _clip("100.0 * {hazard} * (1.0 + {equity} * {svi} / 100.0) / (100.0 * (1.0 + {equity}))", 0.0, 100.0)
_EVI = "((1.0 - {income} / {hi:income}) * 0.35 + (1.0 - {efficiency} / 100.0) * 0.30 + {exposure} / 100.0 * 0.20 + {vulnerable} * 0.15) * 100.0"
_MRT = "({t} + {absorption} * {sun} * (1.0 - {canopy}) * {svf} / 10.0)"
_NORM = lambda x: f"(CASE WHEN {{hi:{x}}} > {{lo:{x}}} THEN ({{{x}}} - {{lo:{x}}}) / ({{hi:{x}}} - {{lo:{x}}}) ELSE 0.0 END)"
_RISK = f"{_NORM('hazard')} * {_NORM('exposure')} * {_NORM('vulnerability')} * 100.0"
_SPREAD = "((0.5 + 0.1 * {wind}) * (1.0 + 0.05 * tan(radians({slope}))) * (1.0 + 0.02 * {wind}))"
_BEAM = "((1160.0 + 75.0 * sin(2.0 * pi() * ({day} - 275.0) / 365.0)) * exp(-(0.174 + 0.035 * sin(2.0 * pi() * ({day} - 100.0) / 365.0)) / sin(radians({altitude}))))"

FORMULAS: dict[str, Formula] = {
    # classes of scores
    "composite_risk_class": Formula("Risk class of a score 0..100.", {"class": _tiers("{score}", (75, "Very High"), (55, "High"), (35, "Moderate"), last="Low")}, {"score": "u * 100"}),
    "accessibility_deficit_class": Formula("Deficit class of a score 0..100.", {"class": _tiers("{score}", (75, "Critical"), (55, "Underserved"), (35, "Watch"), last="Covered")}, {"score": "u * 100"}),
    "intervention_priority_class": Formula("Priority class of a score 0..100.", {"class": _tiers("{score}", (75, "Immediate"), (55, "High"), (35, "Medium"), last="Monitor")}, {"score": "u * 100"}),
    "class_of": Formula("1 + the number of breaks below the value.", {"class": "CASE WHEN {x} <= {b1} THEN 1 WHEN {x} <= {b2} THEN 2 WHEN {x} <= {b3} THEN 3 ELSE 4 END"}, {"x": "s"}, {"b1": 5.0, "b2": 8.0, "b3": 12.0}),
    # heat
    "urban_heat_comfort_risk": Formula("Heat stress from sealing, buildings, lack of green and vulnerable people.", {"score": _COMFORT, "class": _tiers(_COMFORT, (75, "Very High"), (55, "High"), (35, "Moderate"), last="Low")}, {"impervious": "u", "built": "v", "green": "w", "cooling": "s * 20", "vulnerable": "q * 6"}, {"reach": 400.0, "w_imperv": 0.3, "w_green": 0.3, "w_build": 0.25, "w_vuln": 0.15}),
    "urban_heat_island_intensity": Formula("Degrees above the surroundings.", {"uhi": _UHI}, {"albedo": "u", "ndvi": "2 * v - 1", "height": "s", "footprint": "w", "wind": "q * 8"}, {"base": 2.0}),
    "local_climate_zone": Formula("Zone 1..11; later rules override earlier ones, so the last is asked first.", {"lcz": "CASE WHEN {built} < 0 OR {sealed} < 0 OR {height} < 0 THEN 11 WHEN {built} >= 0.05 AND {built} < 0.2 AND {height} >= 3 AND {height} <= 15 THEN 9 WHEN {built} >= 0.2 AND {built} < 0.4 AND {height} >= 5 AND {height} <= 15 AND {sealed} >= 0.7 THEN 10 WHEN {built} >= 0.4 AND {height} >= 3 AND {height} <= 10 AND {sealed} < 0.3 THEN 7 WHEN {built} >= 0.2 AND {built} < 0.4 AND {height} >= 3 AND {height} <= 15 AND {sealed} >= 0.5 THEN 8 WHEN {built} >= 0.4 THEN CASE WHEN {height} > 25 THEN 1 WHEN {height} >= 10 THEN 2 ELSE 3 END WHEN {built} >= 0.2 THEN CASE WHEN {height} > 25 THEN 4 WHEN {height} >= 10 THEN 5 ELSE 6 END ELSE 11 END"}, {"built": "u", "sealed": "v", "height": "s"}),
    "surface_cool_island": Formula("Cooling by brighter surfaces and green.", {"cooling": "greatest(0.0, {target} - {albedo}) * {sun} / 20.0 + 3.0 * {green}", "surface": "{ambient} + (1.0 - {albedo}) * 15.0 - (greatest(0.0, {target} - {albedo}) * {sun} / 20.0 + 3.0 * {green})", "pet_gain": "0.6 * (greatest(0.0, {target} - {albedo}) * {sun} / 20.0 + 3.0 * {green})"}, {"albedo": "u", "target": "v", "green": "w"}, {"sun": 800.0, "ambient": 35.0}),
    "wind_canopy_drag": Formula("Wind at pedestrian level under trees, its loss and comfort class 1..5.", {"speed": _PED, "loss": _clip(f"1.0 - ({_PED}) / {{inflow}}", 0.0, 1.0), "class": f"CASE WHEN {_PED} < 1.8 THEN 1 WHEN {_PED} < 3.6 THEN 2 WHEN {_PED} < 5.3 THEN 3 WHEN {_PED} < 7.6 THEN 4 ELSE 5 END"}, {"inflow": "1 + u * 14", "lai": "v * 5", "frontal": "w"}, {"drag": 0.2}),
    "heatwave_vulnerability": Formula("Heat index and what it means for vulnerable people without air conditioning.", {"heat_index": _HEAT_INDEX, "score": f"{_HEAT_INDEX} / 40.0 * (1.0 + {{vulnerable}}) * (2.0 - {{ac}})"}, {"t": "20 + u * 20", "rh": "30 + v * 60", "vulnerable": "w", "ac": "q"}),
    "heat_risk_index": Formula("Built, high, green and water shares as one score 0..100.", {"score": _clip("100.0 * ({w_built} * " + _clip("{built}", 0.0, 1.0) + " + {w_height} * " + _clip("{height} / {h_ref}", 0.0, 1.0) + " - {w_green} * " + _clip("{green}", 0.0, 1.0) + " - {w_water} * " + _clip("{water}", 0.0, 1.0) + " + greatest({w_green}, {w_water})) / ({w_built} + {w_height} + greatest({w_green}, {w_water}))", 0.0, 100.0)}, {"built": "u", "green": "v", "water": "w", "height": "s"}, {"h_ref": 20.0, "w_built": 0.4, "w_height": 0.2, "w_green": 0.3, "w_water": 0.1}),
    "building_solar_radiation": Formula("Roof irradiation and photovoltaic yield a year.", {"irradiation": "{roof} * {svf} * {sun}", "yield": "{roof} * {svf} * {sun} * {efficiency}"}, {"roof": "s * 10", "svf": "u"}, {"sun": 1200.0, "efficiency": 0.18}),
    "clear_sky_irradiance": Formula("Beam on the ground and diffuse light of a clear sky.", {"beam": f"CASE WHEN {{altitude}} > 0 THEN {_BEAM} * sin(radians({{altitude}})) ELSE 0.0 END", "diffuse": f"CASE WHEN {{altitude}} > 0 THEN (0.095 + 0.04 * sin(2.0 * pi() * ({{day}} - 100.0) / 365.0)) * {_BEAM} ELSE 0.0 END"}, {"altitude": "1 + u * 89", "day": "1 + floor(v * 364)"}),
    "thermal_comfort_pet": Formula("Physiological equivalent temperature, linear form.", {"pet": _clip(f"{{t}} + 0.344 * ({_MRT} - {{t}}) - 0.05 * greatest({{wind}}, 0.1) * ({_MRT} - {{t}}) + 0.07 * 6.11 * pow(10.0, 7.5 * {{t}} / (237.3 + {{t}})) * {{rh}} / 100.0", -10.0, 60.0)}, {"t": "10 + u * 30", "rh": "30 + v * 60", "wind": "w * 8", "sun": "q * 900", "svf": "v", "canopy": "w"}, {"absorption": 0.7}),
    "albedo_cooling_potential": Formula("Temperature drop of a surface brought to the target albedo.", {"drop": "greatest(0.0, {target} - {albedo}) * {sun} / 15.0"}, {"albedo": "u"}, {"target": 0.45, "sun": 800.0}),
    # water
    "scs_runoff": Formula("Runoff depth by curve number.", {"runoff": _RUNOFF}, {"rain": "s * 3", "cn": "40 + u * 59"}),
    "pluvial_flash_flood": Formula("Runoff less what the pipes take.", {"runoff": _RUNOFF, "ponding": f"greatest(0.0, {_RUNOFF} - {{pipes}})"}, {"rain": "s * 3", "cn": "40 + u * 59"}, {"pipes": 25.0}),
    "detention_basin": Formula("Storage for the runoff that building adds.", {"depth": f"greatest(0.0, {_RUNOFF.replace('{cn}', '{cn_post}')} - {_RUNOFF})", "volume": f"greatest(0.0, {_RUNOFF.replace('{cn}', '{cn_post}')} - {_RUNOFF}) * 10.0 * {{area}}", "peak": f"0.208 * {{area}} / 100.0 * {_RUNOFF.replace('{cn}', '{cn_post}')} / greatest(0.6 * {{hours}}, 1e-6)"}, {"area": "s", "cn": "40 + u * 30", "cn_post": "70 + v * 29", "rain": "30 + w * 90"}, {"hours": 6.0}),
    "retention_basin": Formula("Volume, depth and area of an infiltrating basin.", {"volume": "(0.05 + 0.9 * {sealed}) * {rain} / 1000.0 * {area} * 10000.0 * {safety}", "depth": "{infiltration} / 1000.0 * {hours}", "basin_area": "(0.05 + 0.9 * {sealed}) * {rain} / 1000.0 * {area} * 10000.0 * {safety} / ({infiltration} / 1000.0 * {hours})"}, {"area": "s", "sealed": "u", "rain": "20 + v * 60", "infiltration": "2 + w * 20"}, {"hours": 48.0, "safety": 1.2}),
    "green_roof_retention": Formula("Rain that a green roof keeps, in cubic metres.", {"retained": "{area} * {rain} / 1000.0 * {share}"}, {"area": "s * 20", "rain": "u * 60"}, {"share": 0.65}),
    "socio_economic_flood_risk": Formula("Hazard, exposure and vulnerability, each from 0 to 1, multiplied.", {"score": _RISK, "class": _tiers(_RISK, (75, "Very High"), (50, "High"), (25, "Moderate"), last="Low")}, {"hazard": "s", "exposure": "u + price / 1000", "vulnerability": "v"}),
    # ground and fire
    "slope_stability": Formula("Safety of an infinite slope under shaking.", {"safety": _FS, "unstable": f"{_FS} < 1.0"}, {"slope": "u * 60", "cohesion": "v * 20", "friction": "20 + w * 20", "pga": "q * 0.5"}, {"weight": 60.0}),
    "compound_hazard_risk": Formula("Chance that any of three hazards strikes, by exposure.", {"risk": _COMPOUND}, {"depth": "u * 3", "heat": "20 + v * 30", "pga": "w * 0.8", "exposure": "s"}),
    "wildfire_front": Formula("Rate and reach of a fire front and its buffer.", {"rate": _SPREAD, "forward": f"{_SPREAD} * 60.0 * {{hours}}", "flank": f"{_SPREAD} * 24.0 * {{hours}}", "buffer": f"{_SPREAD} * 60.0 * {{hours}} * {{safety}}"}, {"wind": "u * 60", "slope": "v * 45", "hours": "0.5 + w * 5"}, {"safety": 1.5}),
    "magnitude_factor": Formula("Scale of shaking against magnitude 7.", {"factor": "exp(0.8 * ({magnitude} - 7.0))"}, {"magnitude": "5 + u * 4"}),
    "collapse_probability": Formula("Chance of collapse by year of building and magnitude.", {"base": "CASE WHEN {year} <= 1985 THEN 0.85 WHEN {year} <= 2000 THEN 0.60 WHEN {year} <= 2018 THEN 0.25 ELSE 0.05 END", "p": _clip("(CASE WHEN {year} <= 1985 THEN 0.85 WHEN {year} <= 2000 THEN 0.60 WHEN {year} <= 2018 THEN 0.25 ELSE 0.05 END) * exp(0.8 * ({magnitude} - 7.0))", 0.0, 1.0)}, {"year": "1960 + floor(u * 65)", "magnitude": "5 + v * 4"}),
    "debris_extent": Formula("Reach and volume of a collapsed building's debris.", {"reach": "CASE WHEN {collapsed} > 0.5 THEN {height} * {factor} ELSE 0.0 END", "volume": "CASE WHEN {collapsed} > 0.5 THEN {area} * {height} * {solid} ELSE 0.0 END"}, {"height": "s", "area": "u * 900", "collapsed": "v"}, {"factor": 0.4, "solid": 0.3}),
    "road_blockage": Formula("Chance that debris closes a street, and its state.", {"p": f"{{collapse}} * least(1.0, {_RATIO})", "state": f"CASE WHEN {{collapse}} * least(1.0, {_RATIO}) >= 0.7 OR {_RATIO} >= 1.0 THEN 'blocked' WHEN {{collapse}} * least(1.0, {_RATIO}) >= 0.3 THEN 'restricted' ELSE 'open' END"}, {"height": "s", "width": "3 + u * 25", "collapse": "v"}, {"factor": 0.5}),
    # air and noise
    "road_emission": Formula("Grams a kilometre and day.", {"emission": "{aadt} * {ef}"}, {"aadt": "s * 400", "ef": "u"}),
    "air_sample_strength": Formula("Strength of a road sample.", {"strength": "{emission} * 25.0 * greatest({length}, 1e-6) / pi()"}, {"emission": "s * 100", "length": "u * 50"}),
    "canyon_factor": Formula("Gain of a street canyon.", {"factor": "1.0 + least(2.0, {height} / {width})"}, {"height": "s", "width": "5 + u * 30"}),
    "noise_emission": Formula("Level at 25 m by traffic and lorries; null without traffic.", {"level": "CASE WHEN {traffic} > 0 THEN 37.3 + 10.0 * log10({traffic} * (1.0 + 0.082 * " + _clip("{heavy}", 0.0, 100.0) + ")) END"}, {"traffic": "s * 30", "heavy": "u * 30"}),
    "noise_sample_level": Formula("Level of a road sample.", {"level": "{level} + 10.0 * log10(25.0 * greatest({length}, 1e-6) / pi())"}, {"level": "50 + u * 30", "length": "s"}),
    # streets
    "level_of_traffic_stress": Formula("Stress class 1..4 of a street for cycling.", {"lts": "CASE WHEN {speed} <= 30 AND {lanes} <= 2 AND {walk} > 0.5 AND ({traffic} <= 3000 OR {bike} > 0.5) THEN 1 WHEN {speed} <= 40 AND {lanes} <= 2 AND ({bike} > 0.5 OR {walk} > 0.5) THEN 2 WHEN {speed} <= 50 AND (({bike} > 0.5 AND {lanes} <= 4) OR ({lanes} <= 2 AND {traffic} <= 8000)) THEN 3 ELSE 4 END"}, {"speed": "20 + s", "lanes": "1 + floor(u * 5)", "bike": "v", "walk": "w", "traffic": "q * 12000"}),
    "lts_by_infrastructure": Formula("Stress class by kind of way (0 path, 1 lane, 2 mixed).", {"lts": "CASE WHEN {kind} = 0 THEN 1 WHEN {kind} = 1 THEN CASE WHEN {speed} <= 50 AND {lanes} <= 3 THEN 2 ELSE 3 END WHEN {speed} <= 30 AND {lanes} <= 2 AND {traffic} < 1000 THEN 1 WHEN {speed} <= 30 AND {lanes} <= 2 THEN 2 WHEN {speed} <= 50 THEN 3 ELSE 4 END"}, {"kind": "floor(u * 3)", "speed": "20 + s", "lanes": "1 + floor(v * 4)", "traffic": "w * 4000"}),
    "wind_comfort_lawson": Formula("Wind between buildings and what it allows.", {"factor": _AMP, "speed": f"{_AMP} * {{ambient}}", "class": _LAWSON.replace("{0}", f"({_AMP} * {{ambient}})")}, {"height": "s", "width": "5 + u * 30", "ambient": "1 + v * 6"}),
    "pedestrian_level_of_service": Formula("Score and grade of a pavement.", {"score": _PLOS, "grade": _tiers(_PLOS, (5, "A"), (4, "B"), (3, "C"), (2, "D"), (1, "E"), last="F")}, {"width": "0.5 + u * 4", "flow": "v * 80", "lanes": "1 + floor(w * 5)", "speed": "20 + s"}),
    "route_directness": Formula("Network over straight distance; 1 where both ends coincide.", {"directness": "CASE WHEN {euclid} > 0 THEN {network} / {euclid} ELSE 1.0 END"}, {"network": "s * 20", "euclid": "u * 700"}),
    "tobler_speed": Formula("Walking speed by grade, km/h.", {"speed": "6.0 * exp(-3.5 * abs({grade} + 0.05))"}, {"grade": "u - 0.5"}),
    "bpr_travel_time": Formula("Travel time of a loaded link.", {"time": "{free} * (1.0 + {alpha} * pow(greatest(0.0, {flow} / greatest({capacity}, 1e-6)), {beta}))"}, {"flow": "s * 40", "capacity": "500 + u * 1500", "free": "1 + v * 20"}, {"alpha": 0.15, "beta": 4.0}),
    "linear_score": Formula("0..100 between two values.", {"score": _clip("({x} - {zero}) / ({full} - {zero})", 0.0, 1.0) + " * 100.0"}, {"x": "s"}, {"zero": 5.0, "full": 40.0}),
    "kernel_weight": Formula("Gaussian kernel cut at its bandwidth.", {"weight": "CASE WHEN {d} > {h} THEN 0.0 ELSE exp(-4.5 * ({d} / {h}) * ({d} / {h})) END"}, {"d": "s"}, {"h": 30.0}),
    # plots, people, prices
    "spacemate": Formula("Spaciousness, layers and type of fabric.", {"osr": "(1.0 - " + _clip("{gsi}", 1e-4, 1.0) + ") / greatest({fsi}, 1e-4)", "layers": "{fsi} / " + _clip("{gsi}", 1e-4, 1.0), "type": "CASE WHEN {fsi} > 2.0 AND {gsi} > 0.4 THEN 'High-Density Courtyard' WHEN {fsi} > 2.0 THEN 'High-Rise Tower Block' WHEN {fsi} <= 1.0 AND {gsi} <= 0.3 THEN 'Low-Density Suburban' WHEN {gsi} > 0.5 THEN 'Mid-Rise Dense Block' ELSE 'Open Urban Fabric' END"}, {"fsi": "u * 4", "gsi": "v"}),
    "solar_envelope_volume": Formula("What may be built under the sun's angle.", {"volume": "greatest(0.0, {width} - 2.0 * {setback}) * greatest(0.0, {depth} - 2.0 * {setback}) * least({most}, greatest(3.0, {setback} * tan(radians({angle})) + 12.0)) * 0.85"}, {"width": "10 + s", "depth": "10 + u * 40"}, {"angle": 45.0, "setback": 3.0, "most": 30.0}),
    "trip_generation": Formula("Trips that a zone makes and draws.", {"productions": "{pop} * {p_rate}", "attractions": "{jobs} * {a_rate}"}, {"pop": "s * 100", "jobs": "u * 3000"}, {"p_rate": 1.5, "a_rate": 2.0}),
    "housing_needs": Formula("Dwellings to be built.", {"households": "{pop} / {size}", "need": "{pop} / {size} * (1.0 + greatest(0.0, {vacancy})) - {existing} + greatest(0.0, {replacement})"}, {"pop": "s * 100", "existing": "u * 2000", "replacement": "v * 50"}, {"size": 2.4, "vacancy": 0.05}),
    "residential_capacity": Formula("Floor space and dwellings that still fit.", {"buildable": "greatest({area} * greatest({far}, 0.0) - greatest({floor}, 0.0), 0.0)", "units": "floor(greatest({area} * greatest({far}, 0.0) - greatest({floor}, 0.0), 0.0) * {efficiency} / {unit})"}, {"area": "s * 100", "far": "u * 3", "floor": "v * 4000"}, {"efficiency": 0.85, "unit": 90.0}),
    "transit_premium": Formula("Score and price premium of nearness.", {"score": "(0.6 * exp(-{transit} / 800.0) + 0.4 * exp(-{amenity} / 1000.0)) * 100.0", "premium": "{price} * (0.6 * exp(-{transit} / 800.0) + 0.4 * exp(-{amenity} / 1000.0)) * 0.15"}, {"price": "price", "transit": "u * 3000", "amenity": "v * 3000"}),
    "cap_rate": Formula("Years to pay back and value by yield.", {"years": "CASE WHEN {yield} > 0 THEN 1.0 / {yield} END", "value": "CASE WHEN {yield} > 0 THEN {noi} / {yield} ELSE 0.0 END"}, {"yield": "u * 0.1", "noi": "price"}),
    "carbon_sequestration": Formula("Biomass, carbon and yearly uptake of a tree, kg.", {"biomass": "{factor} * 0.15 * pow({dbh}, 2.3)", "carbon": "{factor} * 0.075 * pow({dbh}, 2.3)", "annual": "{factor} * 0.002625 * pow({dbh}, 2.3)"}, {"dbh": "s"}, {"factor": 1.0}),
    "equity_adjusted_priority": Formula("Hazard raised by social vulnerability.", {"score": _PRIORITY, "class": _tiers(_PRIORITY, (75, "Very High"), (55, "High"), (35, "Moderate"), last="Low")}, {"hazard": "u * 100", "svi": "v * 100"}, {"equity": 0.5}),
    "energy_vulnerability": Formula("Income, efficiency, exposure and people at risk.", {"score": _EVI}, {"income": "price", "efficiency": "u * 100", "exposure": "v * 100", "vulnerable": "w"}),
    "equity_weighted_accessibility": Formula("Access weighed by deprivation over its mean.", {"weighted": "{access} * pow({deprivation} / {avg:deprivation}, {alpha})"}, {"access": "s", "deprivation": "0.1 + u"}, {"alpha": 1.0}),
    "tod_node_suitability": Formula("Suitability of a station area.", {"score": "({frequency} / {hi:frequency} * 0.25 + {density} / {hi:density} * 0.25 + {mix} * 0.20 + {walk} / 100.0 * 0.20 + exp(-0.5 * greatest(0.0, {parking} - 0.2)) * 0.10) * 100.0"}, {"frequency": "s", "density": "price", "mix": "u", "walk": "v * 100", "parking": "w"}),
    "micromobility_score": Formula("Vehicles near transit by vulnerability.", {"score": "{vehicles} * exp(-{distance} / 500.0) / ({vulnerability} + 1e-6)"}, {"vehicles": "s", "distance": "u * 2000", "vulnerability": "0.2 + v"}),
    "meshedness": Formula("Alpha, beta and gamma indices of a planar network.", {"alpha": "({edges} - {nodes} + 1.0) / (2.0 * {nodes} - 5.0)", "beta": "{edges} / {nodes}", "gamma": "{edges} / (3.0 * ({nodes} - 2.0))"}, {"nodes": "3 + s", "edges": "3 + s * (1 + u)"}),
}


def text(name: str, column, params: dict[str, float], aggregate) -> dict[str, str]:
    """The outputs' SQL; ``column(x)`` names an input, ``aggregate(kind, x)`` stands for {kind:x}."""
    f = FORMULAS[name]
    values = f.params | params

    def fill(m: re.Match) -> str:
        kind, _, x = m[1].rpartition(":")
        return aggregate(kind, x) if kind else (f"CAST({values[x]!r} AS DOUBLE)" if x in values else column(x))

    return {k: re.sub(r"\{([\w:]+)\}", fill, v) for k, v in f.out.items()}


def apply(df: DataFrame, name: str, columns: dict[str, str] | None = None, **params: float) -> DataFrame:
    """Adds the formula's outputs. ``columns`` maps its inputs to columns of ``df`` (by default of the same names)."""
    f, own = FORMULAS[name], columns or {}
    unknown = set(params) - set(f.params)
    if unknown:
        raise ValueError(f"{name} has no parameter {sorted(unknown)}")
    needed = sorted(set(re.findall(r"\{(\w+):(\w+)\}", " ".join(f.out.values()))))
    if needed:
        stats = df.agg(*(F.expr(f"{AGGREGATES[k]}(`{own.get(x, x)}`)").alias(f"_{k}_{x}") for k, x in needed))
        df = df.crossJoin(F.broadcast(stats))
    out = text(name, lambda x: f"`{own.get(x, x)}`", params, lambda k, x: f"`_{k}_{x}`")
    return df.withColumns({k: F.expr(v if is_label(k, v) else f"CAST({v} AS DOUBLE)") for k, v in out.items()}).drop(*(f"_{k}_{x}" for k, x in needed))


def is_label(name: str, sql: str) -> bool:
    """Classes, names and truth values, which aren't numbers to be rounded."""
    return sql.startswith("CASE") and ("THEN '" in sql or name in ("class", "lts", "lcz")) or sql.endswith("< 1.0")
