"""Site telemetry: profiles, electrical model, scenario effects and residuals, as column expressions.

Noise is drawn from a hash of the second and a seed, so a value does not depend on how rows
are partitioned, and a re-run of a lost task draws the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip
from ..functions.timeaxis import DAY, iso, spine

HOUR = 3600
# Daily peaks of irradiance and daily base temperatures of the reference week, load factor and ratings.
DAY_PEAK = (0.92, 0.85, 0.97, 0.78, 0.90, 0.95, 0.82)
DAY_TEMPERATURE = (15.0, 12.0, 18.0, 10.0, 16.0, 20.0, 14.0)
LOAD_POWER_FACTOR = 0.87
VOLTS_PER_KW = 0.00015
UNBALANCE_LEVELS = (("critical", 0.030), ("warning", 0.020), ("caution", 0.012))


@dataclass(frozen=True)
class Site:
    """Ratings of one site."""

    pv_kw: float = 100.0
    pv_kva: float = 110.0
    storage_kw: float = 50.0
    storage_kva: float = 55.0
    storage_kwh: float = 200.0
    low_percent: float = 10.0
    high_percent: float = 90.0
    start_percent: float = 50.0
    efficiency_in: float = 0.95
    efficiency_out: float = 0.95
    nominal_kv: float = 0.48
    idle_per_hour: float = 0.0001


def noise(t: Column, seed: int, spread: float) -> Column:
    """Normal noise out of two hashes of (seed, second), by the Box-Muller transform."""
    if not spread:
        return F.lit(0.0)
    u, v = ((F.pmod(F.xxhash64(F.lit(seed + k), t), F.lit(1 << 30)) + 1) / float((1 << 30) + 1) for k in (0, 7_919))
    return spread * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def _of_day(day: Column, values: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(day, F.lit(len(values))) + 1).cast("int"))


def irradiance(t: Column) -> Column:
    """Clear-sky irradiance: half a sine from six to eighteen o'clock, scaled to the day's peak."""
    tod = F.pmod(t, F.lit(DAY))
    sun = F.when(tod.between(6 * HOUR, 18 * HOUR), F.sin(math.pi * (tod - 6 * HOUR) / (12 * HOUR))).otherwise(0.0)
    return sun * _of_day(F.floor(t / DAY), DAY_PEAK)


def temperature(t: Column, seed: int = 11, spread: float = 0.5) -> Column:
    swing = 8.0 * F.sin(math.pi * (F.pmod(t, F.lit(DAY)) / DAY - 0.25))
    return clip(_of_day(F.floor(t / DAY), DAY_TEMPERATURE) + swing + noise(t, seed, spread), -5.0, 45.0)


def load(t: Column, seed: int = 12, spread: float = 3.0) -> Column:
    """Weekday or weekend base with a morning and an evening hump."""
    tod, day = F.pmod(t, F.lit(DAY)), F.floor(t / DAY)
    hump = lambda top, start, hours: top * clip(F.sin(math.pi * (tod - start * HOUR) / (hours * HOUR)), 0.0, 1.0)
    base = F.when(F.pmod(day, F.lit(7)) >= 5, 55.0).otherwise(80.0)
    return clip(base + hump(40.0, 6, 4) + hump(50.0, 15, 5) + noise(t, seed, spread), 20.0, 160.0)


def storage_schedule(t: Column, sun: Column, site: Site, seed: int = 101, spread: float = 1.5) -> Column:
    """Discharge in the evening; charge around noon where the sun is strong. Discharge wins."""
    tod = F.pmod(t, F.lit(DAY))
    plan = F.when((tod >= 17 * HOUR) & (tod < 21 * HOUR), 0.7 * site.storage_kw).when((tod >= 10 * HOUR) & (tod < 14 * HOUR) & (sun > 0.5), -0.7 * site.storage_kw * sun).otherwise(0.0)
    return clip(plan + noise(t, seed, spread), -site.storage_kw, site.storage_kw)


def voltage_status(spread: Column) -> Column:
    out = F.lit("normal")
    for name, level in reversed(UNBALANCE_LEVELS):
        out = F.when(spread >= level, name).otherwise(out)
    return out


def electrical(df: DataFrame, site: Site, noisy: bool = True) -> DataFrame:
    """Voltages, currents, power and loading at the point of connection from pv_p_kw, bess_p_kw and load_kw."""
    t, k = F.col("time_s"), float(noisy)
    tan = math.tan(math.acos(LOAD_POWER_FACTOR))
    mean = clip(1.0 + (F.col("pv_p_kw") + F.col("bess_p_kw") - F.col("load_kw")) * VOLTS_PER_KW, 0.90, 1.10)
    df = df.withColumn("_v", mean)
    phases = {c: clip(F.col("_v") + k * offset + noise(t, 20 + i, k * spread), 0.85, 1.15) for i, (c, offset, spread) in enumerate((("pcc_v_a_pu", 0.002, 0.0005), ("pcc_v_b_pu", 0.0, 0.0003), ("pcc_v_c_pu", -0.002, 0.0005)))}
    df = df.withColumns(phases).withColumns({
        "pcc_p_kw": F.col("load_kw") - F.col("pv_p_kw") - F.col("bess_p_kw") + noise(t, 30, k * 0.8),
        "pcc_q_kvar": F.col("load_kw") * tan + noise(t, 31, k * 1.5),
        "pcc_frequency_hz": 60.0 + noise(t, 32, k * 0.005),
        "feeder_head_p_kw": F.col("load_kw") * 8.0 - F.col("pv_p_kw") * 0.8 + noise(t, 33, k * 5.0),
    })
    amps = current(F.col("pcc_p_kw"), F.col("_v"), site)
    df = df.withColumn("_i", amps)
    df = df.withColumns({f"pcc_i_{p}_amp": clip(F.col("_i") * (1 + noise(t, 40 + i, k * 0.015)), 0.0, 500.0) for i, p in enumerate("abc")})
    df = df.withColumns({
        "feeder_head_q_kvar": F.col("feeder_head_p_kw") * tan, "line_loading_max_percent": clip(F.col("_i") / 200.0 * 100.0, 0.0, 150.0),
        "regulator_tap_position": F.lit(1), "capacitor_status": F.when(F.col("_v") < 0.97, 1).otherwise(0),
    })
    return with_voltages(df).drop("_v", "_i")


def current(p: Column, volts: Column, site: Site) -> Column:
    return F.abs(p) / (math.sqrt(3) * volts * site.nominal_kv + 1e-9) * 1000


def with_voltages(df: DataFrame) -> DataFrame:
    """Mean, extremes, unbalance and its level out of the phases."""
    v = [F.col(f"pcc_v_{p}_pu") for p in "abc"]
    mean = (v[0] + v[1] + v[2]) / 3
    spread = F.greatest(*[F.abs(x - mean) for x in v])
    return df.withColumns({"pcc_voltage_mean_pu": mean, "pcc_voltage_unbalance_pu": spread, "voltage_unbalance_status": voltage_status(spread), "voltage_min_pu": F.least(*v), "voltage_max_pu": F.greatest(*v)})


def clouds(df: DataFrame, alpha: float = 0.002, spread: float = 0.08, seed: int = 10) -> DataFrame:
    """``df(time_s, irradiance_pu)`` with slowly changing clouds: smoothed noise, a day a group, from zero each day."""
    raw = df.withColumn("_day", F.floor(F.col("time_s") / DAY)).withColumn("_x", noise(F.col("time_s"), seed, spread))

    def smooth(day: pd.DataFrame) -> pd.DataFrame:
        day = day.sort_values("time_s")
        cloud = day["_x"].ewm(alpha=alpha, adjust=False).mean()
        sun = (day["irradiance_pu"] * (1 + cloud)).clip(0.0, 1.0)
        return day.assign(irradiance_pu=sun.where(day["irradiance_pu"] > 0.001, 0.0)).drop(columns=["_day", "_x"])

    return raw.groupBy("_day").applyInPandas(smooth, df.schema)


def charge_series(df: DataFrame, site: Site, by: list[str], power: str = "bess_p_kw", name: str = "bess_soc_percent", stretch: int = 512) -> DataFrame:
    """State of charge at each second: the level before the second's power acts, clamped again after the idle loss. Stretches of time fold side by side."""
    from .windows import charge_step, clamp, clamps, level_series

    low, high, fold = site.low_percent, site.high_percent, clamps()
    moved = clamp(charge_step(F.col(power), site.storage_kwh, site.efficiency_in, site.efficiency_out, 1 / HOUR), low, high)
    step = fold.then(moved, clamp(F.lit(-100 * site.idle_per_hour / HOUR), low, high))
    levels = level_series(df, by, ["time_s"], F.floor(F.col("time_s") / stretch), step, fold, site.start_percent, True, name)
    return df.join(levels, [*by, "time_s"])


def profile(spark, seconds: int, site: Site | None = None, step: int = 1, base: str = "2024-01-01 00:00:00", noisy: bool = True, axis: DataFrame | None = None) -> DataFrame:
    """The clean table but for the state of charge: time axis (every ``step`` of ``seconds``, or the ``time_s`` of ``axis``), weather, dispatch and electrical columns."""
    site, t = site or Site(), F.col("time_s")
    df = (spine(spark, seconds, step) if axis is None else axis.select("time_s")).withColumn("irradiance_pu", irradiance(t))
    df = clouds(df) if noisy else df
    df = df.withColumns({
        "timestamp_utc": iso(t, base), "temperature_c": temperature(t, spread=0.5 * noisy), "load_kw": load(t, spread=3.0 * noisy),
        "pv_available_kw": F.col("irradiance_pu") * site.pv_kw, "bess_p_kw": storage_schedule(t, F.col("irradiance_pu"), site, spread=1.5 * noisy),
    })
    df = df.withColumns({"pv_p_kw": F.col("pv_available_kw"), "pv_q_kvar": F.lit(0.0), "pv_commanded_p_kw": F.col("pv_available_kw"), "bess_commanded_p_kw": F.col("bess_p_kw"), "bess_q_kvar": F.lit(0.0)})
    return limits(electrical(df, site, noisy), site).withColumns({"physical_scenario_id": F.lit("clean_baseline"), "physical_effect_type": F.lit("none"), "physical_effect_active_flag": F.lit(0)})


def limits(df: DataFrame, site: Site) -> DataFrame:
    """Curtailment and apparent-power flags."""
    over = lambda p, q, rated: (F.hypot(p, q) > rated + 0.5).cast("int")
    return df.withColumns({
        "pv_curtailment_kw": F.greatest(F.col("pv_available_kw") - F.col("pv_p_kw"), F.lit(0.0)),
        "pv_constraint_violation_flag": over("pv_p_kw", "pv_q_kvar", site.pv_kva), "bess_constraint_violation_flag": over("bess_p_kw", "bess_q_kvar", site.storage_kva),
    })


def disturb(clean: DataFrame, scenarios: DataFrame, site: Site | None = None, bucket: int = 900) -> DataFrame:
    """Telemetry under scenarios (scenario_id, effect, start_s, end_s exclusive, size, size2, delay_s); at most one is active at a time.

    Effects: irradiance_drop (factor ``size``), load_step (kW), delayed_limit and wrong_setpoint and
    stale_setpoint (kW), wrong_direction (kW), oscillation, soc_violation, voltage_sag (pu).
    Every column is an expression over the row and its active scenario; dependent columns are derived once, after.
    """
    from .intervals import Interval, inside

    site, t = site or Site(), F.col("time_s")
    active = inside(clean.select("time_s"), "time_s", scenarios, Interval("start_s", "end_s"), bucket)
    active = active.withColumn("acts", (F.col("effect") != "delayed_limit") | (t >= F.col("start_s") + F.col("delay_s")))
    df = clean.join(active.filter("acts").drop("acts"), "time_s", "left")
    e, size = F.col("effect"), F.col("size")
    df = df.withColumn("irradiance_pu", F.when(e == "irradiance_drop", F.col("irradiance_pu") * size).otherwise(F.col("irradiance_pu")))
    df = df.withColumn("pv_available_kw", F.when(e == "irradiance_drop", F.col("irradiance_pu") * site.pv_kw).otherwise(F.col("pv_available_kw")))
    swing = site.pv_kw * F.when(F.pmod(F.floor((t - F.col("start_s")) / 5), F.lit(2)) == 0, 0.8).otherwise(0.2)
    wanted = F.when(e == "irradiance_drop", F.col("pv_commanded_p_kw")).when(e.isin("delayed_limit", "wrong_setpoint", "stale_setpoint"), size).when(e == "oscillation", swing)
    df = df.withColumn("pv_commanded_p_kw", F.when(e == "delayed_limit", size).when(e == "wrong_setpoint", F.col("size2")).otherwise(F.col("pv_commanded_p_kw")))
    df = df.withColumn("pv_p_kw", F.when(wanted.isNotNull(), F.least(wanted, F.col("pv_available_kw"))).otherwise(F.col("pv_p_kw")))
    near_floor = F.col("bess_soc_percent") <= site.low_percent + 2.0 if "bess_soc_percent" in clean.columns else F.lit(False)
    df = df.withColumn("bess_commanded_p_kw", F.when(e == "wrong_direction", size).when(e == "soc_violation", site.storage_kw).otherwise(F.col("bess_commanded_p_kw")))
    df = df.withColumn("bess_p_kw", F.when(e == "wrong_direction", -size).when(e == "soc_violation", F.when(near_floor, 0.0).otherwise(site.storage_kw)).otherwise(F.col("bess_p_kw")))
    df = df.withColumn("soc_violation_flag", ((e == "soc_violation") & near_floor).cast("int")).fillna(0, ["soc_violation_flag"])
    df = df.withColumn("pcc_p_kw", F.when(e == "load_step", F.col("pcc_p_kw") + size).otherwise(F.col("pcc_p_kw")))
    df = df.withColumns({f"pcc_v_{p}_pu": F.when(e == "voltage_sag", clip(F.col(f"pcc_v_{p}_pu") - size, 0.5, 1.15)).otherwise(F.col(f"pcc_v_{p}_pu")) for p in "abc"})
    df = with_voltages(df)
    stepped = clip(current(F.col("pcc_p_kw"), F.col("pcc_voltage_mean_pu"), site), 0.0, 500.0)
    sagged = clip(F.col("pcc_i_a_amp") / F.greatest(F.col("pcc_voltage_mean_pu"), F.lit(0.01)), 0.0, 800.0)
    df = df.withColumns({f"pcc_i_{p}_amp": F.when(e == "load_step", stepped).when(e == "voltage_sag", sagged).otherwise(F.col(f"pcc_i_{p}_amp")) for p in "abc"})
    df = df.withColumns({"physical_effect_active_flag": e.isNotNull().cast("int"), "physical_effect_type": F.coalesce(e, F.lit("none")), "physical_scenario_id": F.coalesce("scenario_id", F.lit("clean_baseline"))})
    return limits(df.select(*[c for c in clean.columns], "soc_violation_flag"), site)


def residuals(clean: DataFrame, attacked: DataFrame, columns: list[str], key: str = "time_s", context: list[str] | None = None) -> DataFrame:
    """``delta_`` of each column by an equi-join on the key, with context columns of the attacked side; columns neither side has are 0."""
    both = [c for c in columns if c in clean.columns and c in attacked.columns]
    joined = clean.select(key, *[F.col(c).alias(f"_{c}") for c in both]).join(attacked.select(key, *both, *(context or [])), key)
    return joined.select(key, *[((F.col(c) - F.col(f"_{c}")) if c in both else F.lit(0.0)).alias(f"delta_{c}") for c in columns], *(context or []))
