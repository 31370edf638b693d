"""Declarative effects on telemetry: who is active when, and a fold of their changes.

Effects that meet on a (time, variable) apply one after the other in their order, each followed by
the variable's bounds. Most change a second by itself, so they fold within a row. Two need another
second's value, as earlier effects left it: ``hold_stale`` that of its first row, ``delay_response``
that of the last row ``ramp_s`` before. These are taken level by level: the level of one is above
those of all earlier ones that it overlaps, so at each level no two meet, and what they read is settled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import Interval, as_of, inside, settled

#: Other names of the effect types.
ALIASES = {"stale_value_hold": "hold_stale", "bounded_clip": "clip", "bounded_oscillation": "smooth_oscillation"}
#: Physical bounds of the variables.
BOUNDS = {
    "pv_p_kw": (0.0, 100.0), "pv_q_kvar": (-60.0, 60.0), "bess_p_kw": (-50.0, 50.0), "bess_q_kvar": (-50.0, 50.0), "bess_soc_percent": (5.0, 95.0),
    "pcc_v_a_pu": (0.90, 1.10), "pcc_v_b_pu": (0.90, 1.10), "pcc_v_c_pu": (0.90, 1.10), "pcc_i_a_amp": (0.0, 500.0), "pcc_i_b_amp": (0.0, 500.0), "pcc_i_c_amp": (0.0, 500.0),
    "pcc_p_kw": (-250.0, 250.0), "pcc_q_kvar": (-150.0, 150.0), "irradiance_pu": (0.0, 1.2),
}


def canonical(effect_type: Column) -> Column:
    out = effect_type
    for alias, name in ALIASES.items():
        out = F.when(effect_type == alias, name).otherwise(out)
    return out


#: Effects that read another second.
READERS = ("hold_stale", "delay_response")
_FIELDS = ("effect_order", "type", "magnitude", "unit", "direction", "shape", "ramp_s", "start_s", "end_s", "level")


def change(value: Column, e: Column, t: Column) -> Column:
    """``value`` after effect ``e`` (struct: type, magnitude, unit, direction, shape, ramp_s, start_s, end_s) at ``t``; of other types, as it is.

    Magnitudes count as absolute; any direction but ``increase`` lowers; ``%`` is a hundredth, any other unit a share.
    """
    size, since = F.abs(e["magnitude"]), (t - e["start_s"]).cast("double")
    sign = F.when(e["direction"] == "increase", 1.0).otherwise(-1.0)
    ramp = F.when((e["shape"] == "ramp") & (e["ramp_s"] > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), since / e["ramp_s"]))).otherwise(1.0)
    share = F.when(e["unit"] == "%", size / 100).otherwise(size)
    period = F.least(F.lit(120.0), F.greatest(F.lit(30.0), (e["end_s"] - e["start_s"]).cast("double")))
    return (
        F.when(e["type"] == "absolute_delta", value + sign * size * ramp)
        .when(e["type"] == "relative_delta", value * (1 + sign * share * ramp))
        .when(e["type"] == "clip", F.least(value, size))
        .when(e["type"] == "smooth_oscillation", value + size * F.sin(2 * F.pi() * since / period))
        .otherwise(value)
    )


def levels(effects: DataFrame, bucket: int) -> tuple[DataFrame, int]:
    """``effects`` with the level of those that read another second (else NULL), and the highest level.

    Effects are few against the data; overlaps are found by an equi-join on buckets, and levels rise until none changes.
    """
    readers = effects.filter(F.col("type").isin(*READERS) & (F.col("start_s") < F.col("end_s"))).select("variable", "effect_order", "start_s", "end_s").distinct()
    if readers.isEmpty():
        return effects.withColumn("level", F.lit(None).cast("int")), 0
    spans = readers.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_s") / bucket), F.floor((F.col("end_s") - 1) / bucket))))
    one, two = (spans.select("variable", "_bucket", *[F.col(c).alias(f"{c}_{x}") for c in ("effect_order", "start_s", "end_s")]) for x in ("a", "b"))
    meet = (F.col("effect_order_a") < F.col("effect_order_b")) & (F.col("start_s_a") < F.col("end_s_b")) & (F.col("start_s_b") < F.col("end_s_a"))
    pairs = settled(one.join(two, ["variable", "_bucket"]).filter(meet).select("variable", "effect_order_a", "effect_order_b").distinct(), "pairs")
    level = settled(readers.select("variable", "effect_order", F.lit(1).alias("level")), "levels")
    while True:
        below = level.select("variable", F.col("effect_order").alias("effect_order_a"), F.col("level").alias("below"))
        over = pairs.join(below, ["variable", "effect_order_a"]).groupBy("variable", F.col("effect_order_b").alias("effect_order")).agg((F.max("below") + 1).alias("over"))
        raised = settled(level.join(over, ["variable", "effect_order"], "left").select("variable", "effect_order", F.coalesce("over", F.lit(1)).alias("level"), (F.coalesce("over", F.lit(1)) != F.col("level")).alias("moved")), "levels")
        level = raised.drop("moved")
        if raised.filter("moved").isEmpty():
            break
    return effects.join(level, ["variable", "effect_order"], "left"), level.agg(F.max("level")).first()[0]


def apply_effects(signals: DataFrame, effects: DataFrame, bucket: int = 3600, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``signals(time_s, variable, value)`` with how many ``effects`` meet there and the value they leave, ``changed``.

    ``effects``: variable, effect_order, type, magnitude, unit, direction, shape, ramp_s, start_s, end_s
    (exclusive). ``effect_order`` may have any type that sorts (such as a struct of bundle, place of
    the scenario and of the effect) and is unique for a variable. ``delay_response`` leaves the
    first ``ramp_s`` seconds of its window as they are. A null value stays null, an unknown type only
    brings the bounds.
    """
    bounds = BOUNDS if bounds is None else bounds
    named, top = levels(effects.withColumn("type", canonical(F.col("type"))), bucket)
    active = inside(signals.select("time_s", "variable").distinct(), "time_s", named, Interval("start_s", "end_s"), bucket, ["variable"])
    held = active.groupBy("time_s", "variable").agg(F.array_sort(F.collect_list(F.struct(*_FIELDS))).alias("_effects"))
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    for variable, (a, b) in bounds.items():
        low, high = F.when(F.col("variable") == variable, a).otherwise(low), F.when(F.col("variable") == variable, b).otherwise(high)

    def bounded(value: Column) -> Column:
        return F.when(value.isNotNull(), F.least(high, F.greatest(low, value)))

    def fold(which: Column) -> Column:
        return F.aggregate(which, F.col("_now"), lambda v, e: bounded(change(v, e, F.col("time_s"))))

    rows = signals.join(held, ["time_s", "variable"], "left").withColumn("_now", F.col("value").cast("double"))
    rows = rows.withColumn("_done", F.lit(None).cast(effects.schema["effect_order"].dataType))
    after = lambda e: F.col("_done").isNull() | (e["effect_order"] > F.col("_done"))
    for level in range(1, top + 1):
        rows = rows.withColumn("_reader", F.get(F.filter("_effects", lambda e: F.coalesce(e["level"] == level, F.lit(False))), F.lit(0)))
        before = F.filter("_effects", lambda e: after(e) & (e["effect_order"] < F.col("_reader.effect_order")))
        rows = settled(rows.withColumn("_now", F.when(F.col("_reader").isNotNull() & F.col("_now").isNotNull(), fold(before)).otherwise(F.col("_now"))), "effects")
        rows = _read(rows, bucket)
        read = F.when(F.col("_reader.type") == "hold_stale", F.col("_held")).otherwise(F.coalesce("_shifted", "_now"))
        rows = rows.withColumn("_now", F.when(F.col("_reader").isNotNull(), bounded(read)).otherwise(F.col("_now"))).withColumn("_done", F.coalesce("_reader.effect_order", "_done"))
        rows = rows.drop("_reader", "_held", "_shifted")
    left = F.when(F.col("_effects").isNotNull() & F.col("_now").isNotNull(), fold(F.filter("_effects", after))).otherwise(F.col("_now"))
    return rows.select("time_s", "variable", "value", F.coalesce(F.size("_effects"), F.lit(0)).alias("effects"), left.alias("changed"))


def _read(rows: DataFrame, bucket: int) -> DataFrame:
    """``rows`` with ``_held``, their reader's first value, and ``_shifted``, the last value ``ramp_s`` before inside its window."""
    reads = rows.filter("_reader is not null").select("variable", F.col("_reader.effect_order").alias("_of"), "time_s", "_now", F.col("_reader.type").alias("_type"), F.col("_reader.ramp_s").alias("_ramp"))
    first = reads.filter(F.col("_type") == "hold_stale").groupBy("variable", "_of").agg(F.min_by("_now", "time_s").alias("_held"))
    late = reads.filter(F.col("_type") == "delay_response")
    points = late.select("variable", "_of", (F.col("time_s") - F.col("_ramp")).alias("time_s"), F.col("time_s").alias("_at"))
    shifted = as_of(points, late.select("variable", "_of", "time_s", F.col("_now").alias("_shifted")), "time_s", ["_shifted"], ["variable", "_of"], bucket)
    shifted = shifted.select("variable", "_of", F.col("_at").alias("time_s"), "_shifted").distinct()
    rows = rows.withColumn("_of", F.col("_reader.effect_order"))
    return rows.join(first, ["variable", "_of"], "left").join(shifted, ["variable", "_of", "time_s"], "left").drop("_of")


def write_back(base: DataFrame, resolved: DataFrame, key: str, values: list[str], method: str, allowed: list[str], fallback: str) -> DataFrame:
    """``base`` with the values and the method of rows that ``resolved`` has; methods outside ``allowed`` become the ``fallback``."""
    new = resolved.select(key, *[F.col(v).alias(f"_{v}") for v in (*values, method)], F.lit(True).alias("_there"))
    joined = base.join(new, key, "left")
    changed = {v: F.when(F.col("_there"), F.col(f"_{v}")).otherwise(F.col(v)) for v in (*values, method)}
    joined = joined.withColumns(changed).withColumn(method, F.when(F.col(method).isin(allowed), F.col(method)).otherwise(fallback))
    return joined.select(*base.columns)
