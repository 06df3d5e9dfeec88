"""Small column expressions and option parsing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from tapeforge.schemas import PROJ_INTERCEPT_PCT, PROJ_TRAVEL_COEF

DAYS_PER_YEAR = 365.25


def rounded(col: Column | str, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or not positive."""
    return F.when(b > 0, a / b)


def projected_move(pattern: Column, close: Column, mid_travel: Column) -> Column:
    """Projected absolute move in price units; only defined for the wedge formation."""
    pct = F.greatest(F.lit(PROJ_INTERCEPT_PCT) + F.lit(PROJ_TRAVEL_COEF) * mid_travel, F.lit(0.0))
    return F.when(pattern == "wedge", F.round(close * pct / 100, 4))


def slope_class(mid: Column, flat: float = 0.15) -> Column:
    return F.when(mid >= flat, "rising").when(mid <= -flat, "falling").otherwise("flat")


def lenient_number(col: Column) -> Column:
    """Text to double; blanks and junk become null."""
    return F.trim(col).try_cast("double")


def years_between(first: Column, last: Column) -> Column:
    """Whole days between two timestamps in years."""
    days = F.floor((F.unix_timestamp(last) - F.unix_timestamp(first)) / 86400)
    return days / DAYS_PER_YEAR


def parse_assignments(specs: Iterable[str], kind=float) -> dict[str, float]:
    """``NAME=VALUE`` options to a dict; a malformed option is an error."""
    out = {}
    for spec in specs:
        name, sep, value = spec.partition("=")
        if not sep or not name.strip():
            raise ValueError(f"expected NAME=VALUE, got {spec!r}")
        out[name.strip()] = kind(value)
    return out


def resolve_thresholds(formations: list[dict], override: float | None = None,
                       per_pattern: dict[str, float] | None = None) -> list[dict]:
    """Formation settings with thresholds replaced: own default, then global, then per pattern."""
    per_pattern = per_pattern or {}
    unknown = set(per_pattern) - {f["pattern"] for f in formations}
    if unknown:
        raise ValueError(f"unknown formation(s): {', '.join(sorted(unknown))}")
    return [{**f, "threshold": per_pattern.get(f["pattern"], f["threshold"] if override is None else override)}
            for f in formations]
