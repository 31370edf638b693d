"""What a scenario says about each second beside it: flags, states, context windows, evidence and packets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEK = 604_800


def family_flags(family: Column, delivery: Column) -> dict[str, Column]:
    """0/1 flags a family and a delivery status imply."""
    has = lambda *words: reduce(lambda a, b: a | b, [F.lower(family).contains(w) for w in words])
    flags = {
        "command_delay_active_flag": has("delay") | (delivery == "delayed"), "blocked_flag": has("suppress", "block") | delivery.isin("blocked", "suppressed"), "replay_flag": delivery == "replayed",
        "mismatch_flag": has("false_data", "mismatch", "oscillatory"), "stale_command_flag": has("stale"), "timeout_flag": has("availability"),
    }
    return {name: F.coalesce(x, F.lit(False)).cast("int") for name, x in flags.items()}


def security_statuses(dimension: Column, scenario_class: Column) -> dict[str, Column]:
    cyber = scenario_class.isin("cyber_only", "cyber_physical")
    says = lambda word, bad, good: F.when(cyber & F.lower(dimension).contains(word), bad).otherwise(good)
    return {
        "authn_status": F.lit("passed"), "authz_status": says("access_control", "violated", "passed"), "integrity_status": says("integrity", "compromised", "passed"),
        "availability_status": says("availability", "degraded", "normal"), "confidentiality_status": says("confidentiality", "compromised", "passed"),
    }


def cyber_state(scenario_class: Column, family: Column, stage: Column) -> Column:
    cases = (("suppres", "blocked_command"), ("block", "blocked_command"), ("delay", "delayed_command_context"), ("stale", "stale_measurement_context"), ("false_data", "false_data_context"), ("availability", "availability_degraded"))
    out = F.when(scenario_class == "cyber_physical", "cyber_physical_effect_active").otherwise("security_event_active")
    for word, name in reversed(cases):
        out = F.when(F.lower(family).contains(word), name).otherwise(out)
    quiet = (scenario_class == "normal") | ((scenario_class == "physical_only") & (stage != "physical_event_observed"))
    return F.when(quiet, "normal_monitoring").when(scenario_class == "physical_only", "physical_event_observed").otherwise(out)


def ramp_seconds(effects: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(effects, lambda e: e["ramp_seconds"])), F.lit(0))


def delay_seconds(family: Column, effects: Column, duration: Column) -> Column:
    """30 s at least, the longest ramp or a quarter of the duration, where the family is a delay."""
    ramp = ramp_seconds(effects)
    return F.when(F.lower(family).contains("delay"), F.greatest(F.lit(30), F.when(ramp > 0, ramp).otherwise(F.floor(duration / 4)))).otherwise(0)


def context_flags(t: Column, sent: Column, applied: Column, start: Column, end: Column, onset: Column, anomalous: Column) -> dict[str, Column]:
    """Flags of a second beside a scenario's times (NULL where unknown)."""
    physical = F.coalesce(t.between(start, end), F.lit(False))
    cyber = onset.isNotNull() & F.coalesce(t.between(sent, sent + 120), F.lit(False))
    command = F.coalesce(F.when(applied.isNotNull(), t.between(sent, applied + 60)).otherwise(t.between(sent, sent + 120)), F.lit(False))
    attack = anomalous & (physical | F.coalesce(t.between(onset, onset + 60), F.lit(False)))
    return {"cyber_active_flag": cyber.cast("int"), "command_active_flag": command.cast("int"), "physical_effect_active_flag": physical.cast("int"), "attack_active_flag": attack.cast("int")}


def context_bounds(scenarios: DataFrame, before: int = 120, after: int = 300, last: int = WEEK - 1) -> DataFrame:
    """(window_start_s, window_end_s): around the physical start, or else the application, or else the command; past a known end by ``before``."""
    anchor = F.coalesce("effect_start_s", "apply_s", "sent_s", F.lit(0))
    end = F.coalesce(F.col("effect_end_s") + before, anchor + after)
    return scenarios.withColumns({"window_start_s": F.greatest(F.lit(0), anchor - before), "window_end_s": F.least(F.lit(last), end)})


def constraint_checks(windows: DataFrame, by: str = "scenario_id", power_limit: float = 110.0, low: float = 10.0, high: float = 90.0, residual_limit: float = 0.05) -> DataFrame:
    """An array of checks of each scenario's window: power, charge and voltage residual against their limits."""
    sums = windows.groupBy(by).agg(F.max(F.abs("actual_p_kw")).alias("p"), F.min("actual_soc_percent").alias("lo"), F.max("actual_soc_percent").alias("hi"), F.max(F.abs("residual_voltage_pu")).alias("v"))
    one = lambda name, ok, bad, value, limit, digits: F.struct(F.lit(name).alias("constraint"), F.when(ok, "pass").otherwise(bad).alias("status"), F.round(value, digits).alias("value"), F.lit(limit).alias("limit"))
    checks = F.array(
        one("pv_apparent_power_limit", F.col("p") <= power_limit, "fail", F.col("p"), power_limit, 2), one("bess_soc_min", F.col("lo") >= low - 0.5, "fail", F.col("lo"), low, 2),
        one("bess_soc_max", F.col("hi") <= high + 0.5, "fail", F.col("hi"), high, 2), one("voltage_residual_threshold", F.col("v") < residual_limit, "warning", F.col("v"), residual_limit, 4),
    )
    return sums.select(by, checks.alias("checks"))


def physical_evidence(windows: DataFrame, by: str = "scenario_id", signals: tuple[str, ...] = ("p_kw", "q_kvar", "voltage_pu", "soc_percent")) -> DataFrame:
    """An array of mean baseline, actual and residual of each signal."""
    kinds = ("baseline", "actual", "residual")
    sums = windows.groupBy(by).agg(*[F.round(F.avg(f"{k}_{s}"), 3).alias(f"{k}_{s}") for s in signals for k in kinds])
    return sums.select(by, F.array(*[F.struct(F.lit(s).alias("field"), *[F.col(f"{k}_{s}").alias(k) for k in kinds]) for s in signals]).alias("evidence"))


def packets(scenarios: DataFrame, checks: DataFrame, evidence: DataFrame, by: str = "scenario_id") -> DataFrame:
    """One nested document a scenario."""
    joined = scenarios.join(checks, by, "left").join(evidence, by, "left")
    focus = F.when(F.col("scenario_class") == "normal", "baseline behaviour").when(F.col("scenario_class") == "cyber_only", "event log without physical change").when(F.col("scenario_class") == "physical_only", "physical change without command").otherwise("command and physical change together")
    timing = F.format_string("active from %d s to %d s", F.col("start_time_s"), F.col("start_time_s") + F.col("duration_s") - 1)
    return joined.select(by, F.to_json(F.struct(F.col(by), "scenario_class", "scenario_family", focus.alias("focus"), timing.alias("timing"), F.col("evidence").alias("physical_evidence"), F.col("checks").alias("constraint_checks"))).alias("packet"))
