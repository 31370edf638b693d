"""Scalar helpers: rounding, text, JSON and status expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_token(text: Column, separator: str = "_") -> Column:
    return F.element_at(F.split(text, separator), 1)


def rest_tokens(text: Column, separator: str = "_") -> Column:
    parts = F.split(text, separator)
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), separator)


def padded_id(prefix: str, n: Column, width: int = 7) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def finite(x: Column, digits: int | None = None) -> Column:
    """NULL for NaN and infinities; rounded where asked."""
    x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
    return x if digits is None else F.round(x, digits)


def relative_residual(delta: Column, base: Column) -> Column:
    return F.abs(delta) / (F.abs(base) + 1)


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.least(F.greatest(x, low), high)


def imbalance(phases: list[Column], warn: float = 0.01, alarm: float = 0.02, trip: float = 0.03) -> tuple[Column, Column, Column]:
    """(mean, largest deviation from it, status of four levels) of parallel measurements."""
    mean = sum(phases[1:], phases[0]) / len(phases)
    spread = F.greatest(*[F.abs(p - mean) for p in phases])
    status = F.when(spread < warn, "NORMAL").when(spread < alarm, "WARNING").when(spread < trip, "ALARM").otherwise("TRIP")
    return mean, spread, status


def json_object_text(text: Column) -> Column:
    """The outermost ``{...}`` in free text, code fences and prose around it dropped; '' without one."""
    bare = F.regexp_replace(text, "(?i)```(?:json)?", "")
    return F.regexp_extract(bare, r"(?s)\{.*\}", 0)


def text_list(value: Column) -> Column:
    """A JSON list of texts; a lone text becomes a list of one, empty text an empty list."""
    parsed = F.from_json(value, "array<string>")
    none = F.array().cast("array<string>")
    return F.when(value.isNull() | (F.trim(value) == ""), none).when(value.startswith("["), F.coalesce(parsed, none)).otherwise(F.array(value))


def distinct_in_order(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def choose(value: Column, cases: dict[str, object], default: object = None) -> Column:
    """A lookup as one CASE expression."""
    out = F.lit(default)
    for key, result in reversed(cases.items()):
        out = F.when(value == key, F.lit(result)).otherwise(out)
    return out
