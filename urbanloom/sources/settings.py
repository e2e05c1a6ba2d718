"""Settings written as text: ``key=value`` entries split by commas or semicolons, and lists of numbers."""

from __future__ import annotations

#: The traffic-stress thresholds.
LTS_RULES = {
    "path_lts": 1.0,
    "lane_lts2_speed": 50.0,
    "lane_lts2_lanes": 3.0,
    "lane_lts_low": 2.0,
    "lane_lts_high": 3.0,
    "mixed_lts1_speed": 30.0,
    "mixed_lts1_lanes": 2.0,
    "mixed_lts1_aadt": 1000.0,
    "mixed_lts2_speed": 30.0,
    "mixed_lts2_lanes": 2.0,
    "mixed_lts3_speed": 50.0,
}
BREAKS = (5.0, 8.0, 12.0)


def _number(text: str, about: str) -> float:
    try:
        return float(text)
    except ValueError as e:
        raise ValueError(f"not a number in {about!r}") from e


def tokens(text: str | None) -> list[str]:
    """The entries between commas or semicolons, without blanks about them; empty ones are left out."""
    return [t for t in (t.strip() for t in str(text or "").replace(";", ",").split(",")) if t]


def entries(text: str | None, least: float | None = None, strict: bool = False, lower: bool = True) -> list[tuple[str, float]]:
    """(key, value) of ``key=value`` entries in order; values at least (``strict``: above) ``least``."""
    out = []
    for token in tokens(text):
        key, mark, value = (x.strip() for x in token.partition("="))
        if not mark or not key:
            raise ValueError(f"not a key=value entry: {token!r}")
        number = _number(value, token)
        if least is not None and not (number > least if strict else number >= least):
            raise ValueError(f"{token!r} is out of range")
        out.append((key.lower() if lower else key, number))
    return out


def _some(found: list, what: str) -> list:
    if not found:
        raise ValueError(f"no {what} given")
    return found


def breaks(text: str | None, default: tuple[float, ...] = BREAKS) -> tuple[float, ...]:
    """Ascending class breaks; ``default`` for no text."""
    if not (text or "").strip():
        return default
    out = tuple(_number(t.strip(), text) for t in text.split(","))
    if any(b <= a for a, b in zip(out, out[1:])):
        raise ValueError(f"breaks must ascend: {text!r}")
    return out


def lts_rules(text: str | None) -> dict[str, float]:
    """The traffic-stress thresholds, with those that the text names replaced."""
    found = entries(text)
    unknown = [k for k, _ in found if k not in LTS_RULES]
    if unknown:
        raise ValueError(f"unknown rules {unknown}")
    return LTS_RULES | dict(found)


def hierarchy(text: str) -> list[tuple[float, float]]:
    """(least hectares, farthest distance) of ``size=distance`` entries, by size."""
    return sorted((_number(k, text), v) for k, v in _some(entries(text), "classes"))


def standards(text: str) -> list[tuple[str, float]]:
    """(keyword, square metres a head), in order; the first keyword that a category holds applies."""
    return _some(entries(text, 0.0), "standards")


def targets(text: str) -> list[tuple[str, float]]:
    """(use, area), in order."""
    return _some(entries(text, 0.0), "targets")


def weights(text: str | None, known) -> tuple[dict[str, float], list[str]]:
    """Weights above 0 by key, and the keys that aren't ``known``, each once in order."""
    found = entries(text, 0.0, True, False)
    return dict(found), [k for k in dict(found) if k not in known]


def radii(text: str | None) -> list[float | None]:
    """Search radii; n, rn, global and inf mean none, as no text does."""
    out: list[float | None] = []
    for token in tokens(text):
        value = None if token.lower() in ("n", "rn", "global", "inf") else _number(token, token)
        if value is not None and not value > 0:
            raise ValueError(f"a radius must be above 0: {token!r}")
        out.append(value)
    return out or [None]


def radius_label(radius: float | None) -> str:
    return "n" if radius is None else f"{radius:g}"
