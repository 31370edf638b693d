"""Command lifecycles: expansion to stages, and pivots of stages to times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stages of each lifecycle kind, in order.
STAGES = {
    "normal": ["DER_CONTROL_CREATED", "DER_CONTROL_SENT", "DER_CONTROL_RECEIVED", "DER_CONTROL_ACCEPTED", "DER_CONTROL_APPLIED", "DER_CONTROL_RESPONSE"],
    "blocked": ["DER_CONTROL_CREATED", "DER_CONTROL_SENT", "SECURITY_AUTH_FAILURE", "SECURITY_BLOCKED_COMMAND"],
    "replay": ["DER_CONTROL_CREATED", "DER_CONTROL_SENT", "SECURITY_REPLAY_DETECTED", "DER_CONTROL_REJECTED"],
    "wrong_setpoint": ["DER_CONTROL_CREATED", "DER_CONTROL_SENT", "DER_CONTROL_RECEIVED", "SECURITY_INTEGRITY_MISMATCH", "DER_CONTROL_APPLIED", "DER_CONTROL_RESPONSE"],
    "soc_violation": ["DER_CONTROL_CREATED", "DER_CONTROL_SENT", "DER_CONTROL_RECEIVED", "DER_CONTROL_ACCEPTED", "DER_CONTROL_APPLIED", "DER_CONTROL_RESPONSE"],
    "delayed": ["DER_CONTROL_CREATED", "DER_CONTROL_SENT", "DER_CONTROL_RECEIVED", "DER_CONTROL_ACCEPTED", "DER_CONTROL_APPLIED", "DER_CONTROL_RESPONSE"],
    "burst": ["DER_CONTROL_CREATED", "DER_CONTROL_SENT", "DER_CONTROL_RECEIVED", "DER_CONTROL_ACCEPTED", "DER_CONTROL_APPLIED", "DER_CONTROL_RESPONSE"],
}


def stage_list(kind: Column) -> Column:
    out = F.array(*map(F.lit, STAGES["normal"]))
    for name, stages in STAGES.items():
        out = F.when(kind == name, F.array(*map(F.lit, stages))).otherwise(out)
    return out


def expand(commands: DataFrame, kind: str, created: str, gaps: list[int]) -> DataFrame:
    """A row for each stage: its order, name and time. Times go by position: stage i is at the i-th of the six times."""
    total, offsets = 0, [0]
    for gap in gaps:
        total += gap
        offsets.append(total)
    times = F.array(*[F.lit(x) for x in offsets])
    rows = commands.select("*", F.posexplode(stage_list(F.col(kind))).alias("lifecycle_order", "lifecycle_stage"))
    return rows.withColumn("stage_time_s", F.col(created) + F.element_at(times, F.least(F.col("lifecycle_order"), F.lit(len(offsets) - 1)) + 1))


def stage_times(events: DataFrame, key: str, stage: str, time: str, stages: list[str], suffix: str = "_time") -> DataFrame:
    """A row for each key with the first time of each named stage: one aggregation, no pivot pass for the names."""
    return events.groupBy(key).agg(*[F.min(F.when(F.col(stage) == s, F.col(time))).alias(f"{s.lower()}{suffix}") for s in stages])


def burst(commands: DataFrame, key: str, time: str, copies: Column, apart: int) -> DataFrame:
    """``copies`` of each command, ``apart`` seconds from each other, with numbered ids."""
    rows = commands.withColumn("burst", F.explode(F.sequence(F.lit(0), copies - 1)))
    return rows.withColumn(key, F.concat(F.col(key).cast("string"), F.lit("_burst"), F.col("burst").cast("string"))).withColumn(time, F.col(time) + F.col("burst") * apart)


def statuses(kind: Column) -> dict[str, Column]:
    """Authorisation, integrity, availability, delivery and outcome by lifecycle kind."""
    return {
        "authz_status": F.when(kind == "blocked", "failed").otherwise("passed"),
        "integrity_status": F.when(kind == "wrong_setpoint", "compromised").otherwise("passed"),
        "availability_status": F.when(kind.isin("delayed", "burst"), "degraded").otherwise("normal"),
        "delivery_status": F.when(kind == "blocked", "blocked").when(kind == "delayed", "delayed").otherwise("delivered"),
        "comm_outcome": F.when(kind == "blocked", "blocked").when(kind == "replay", "replay_detected").when(kind == "wrong_setpoint", "integrity_mismatch").otherwise("success"),
    }


def latencies(key: Column, delayed: Column, extra_s: float = 10.0) -> dict[str, Column]:
    """Network, processing and queue milliseconds (with floors) and the total delay in seconds (of the parts before their floors).

    Draws are normal, from hashes of the key, so that a command has the same latencies in every run.
    """
    # Mean and spread of each part, its floor; for normal and for delayed commands.
    normal = (("network", 50.0, 15.0, 5.0), ("processing", 20.0, 5.0, 5.0), ("queue", 5.0, 2.0, 0.5))
    slow = (("network", 8000.0, 2000.0, 100.0), ("processing", 40.0, 20.0, 10.0), ("queue", 500.0, 100.0, 50.0))
    out, total = {}, F.lit(0.0)
    for i, ((name, mean, spread, floor), (_, mean2, spread2, floor2)) in enumerate(zip(normal, slow, strict=True)):
        part = F.when(delayed, mean2 + spread2 * drawn(key, 300 + i)).otherwise(mean + spread * drawn(key, 200 + i))
        out[f"{name}_latency_ms"] = F.greatest(part, F.when(delayed, floor2).otherwise(floor))
        total = total + part
    return out | {"total_delay_s": F.when(delayed, extra_s).otherwise(0.0) + total / 1000}


def observed_stages(scenarios: DataFrame, last: int = 604_799) -> DataFrame:
    """The lifecycle rows of a scenario by its class and family: stage, time, and whether cyber and physical effects are active.

    scenarios: scenario_id, scenario_class, scenario_family, start_time_s, duration_s, ramp_s.
    """
    start, family = F.col("start_time_s"), F.lower("scenario_family")
    end, mid = start + F.col("duration_s") - 1, start + F.floor(F.col("duration_s") / 2)
    delay = F.when(family.contains("delay"), F.greatest(F.lit(30), F.when(F.col("ramp_s") > 0, F.col("ramp_s")).otherwise(F.floor(F.col("duration_s") / 4)))).otherwise(0)
    has = lambda *words: reduce(lambda a, b: a | b, [family.contains(w) for w in words])

    def rows(*each: tuple) -> Column:
        clamp = lambda t: F.least(F.lit(last), F.greatest(F.lit(0), t)).cast("long")
        return F.array(*[F.struct(F.lit(s).alias("lifecycle_stage"), clamp(t).alias("event_time_s"), F.lit(c).alias("cyber_active"), F.lit(p).alias("physical_active")) for s, t, c, p in each])

    # Stages by class, and of cyber-only scenarios by family.
    cyber_only = (
        F.when(has("suppres", "block"), rows(("command_created", start - 4, 1, 0), ("command_sent", start, 1, 0), ("command_blocked", start, 1, 0), ("security_alert_active", mid, 1, 0)))
        .when(has("delay"), rows(("command_created", start - 4, 1, 0), ("command_sent", start, 1, 0), ("command_delay_observed", start + delay, 1, 0), ("timeout_flagged", end, 1, 0)))
        .when(has("stale"), rows(("telemetry_received", start, 1, 0), ("stale_measurement_context", mid, 1, 0), ("stale_measurement_resolved", end, 1, 0)))
        .when(has("false_data"), rows(("telemetry_sent", start, 1, 0), ("mismatch_detected_context", mid, 1, 0)))
        .when(has("availability"), rows(("status_request_sent", start, 1, 0), ("timeout_observed", mid, 1, 0), ("availability_degraded", end, 1, 0)))
        .otherwise(rows(("cyber_event_start", start, 1, 0), ("security_alert", mid, 1, 0), ("cyber_event_end", end, 1, 0)))
    )
    peak = start + F.greatest(F.col("ramp_s"), F.floor(F.col("duration_s") / 3))
    both = rows(("command_created", start - 5, 1, 0), ("command_sent", start - 4, 1, 0), ("command_received", start - 3, 1, 0), ("command_accepted", start - 2, 1, 0),
                ("command_applied", start + delay, 1, 1), ("physical_response_observed", peak, 1, 1), ("status_report", end, 1, 1))
    kind = F.col("scenario_class")
    every = (
        F.when(kind == "normal", rows(("status_report", start, 0, 0), ("monitoring_complete", end, 0, 0)))
        .when(kind == "physical_only", rows(("monitoring_pre_event", start, 0, 0), ("physical_event_observed", start + F.greatest(F.col("ramp_s"), F.lit(1)), 0, 1), ("monitoring_post_event", end, 0, 1)))
        .when(kind == "cyber_only", cyber_only).when(kind == "cyber_physical", both)
    )
    return scenarios.select("*", F.posexplode(every).alias("lifecycle_order", "_r")).select(*scenarios.columns, "lifecycle_order", "_r.*")


def stage_at(kind: Column, t: Column, start: Column, ramp: Column, applied: Column) -> Column:
    """The lifecycle stage of a second inside a scenario, by its class and the time since its start."""
    physical = F.when(t - start >= ramp, "physical_event_observed").otherwise("monitoring_pre_event")
    both = F.when(t < applied, "command_pipeline").when(t < start + ramp + 1, "command_applied").otherwise("physical_effect_active")
    return F.when(kind == "normal", "normal_monitoring").when(kind == "physical_only", physical).when(kind == "cyber_only", "cyber_event_active").otherwise(both)


def drawn(key: Column, seed: int) -> Column:
    """A standard normal number out of the MD5 of (seed, key), by the Box-Muller transform."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    part = lambda at: (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 1) / 4294967297.0
    return F.sqrt(-2 * F.log(part(1))) * F.cos(2 * F.pi() * part(9))


def message_id(*parts: Column) -> Column:
    """A UUID that depends on its parts alone, so that a row has the same one in every run."""
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


#: Routine rows of a day, as seconds after midnight; command hours, storage at two, meters every quarter, status every hour.
ROUTINES = {"command": [h * 3600 for h in range(6, 20, 2)] + [20 * 3600], "storage": [11 * 3600, 18 * 3600], "metering": list(range(0, 86_400, 900)), "status": list(range(0, 86_400, 3600))}


def routines(days: DataFrame, day: str, kinds: dict[str, list[int]] | None = None) -> DataFrame:
    """``days`` once for each second of each routine: ``routine`` and ``time_s``."""
    def routine(name: str, at: list[int]) -> Column:
        return F.transform(F.array(*map(F.lit, at)), lambda s: F.struct(F.lit(name).alias("routine"), (F.col(day) * 86_400 + s).cast("long").alias("time_s")))

    each = [routine(name, at) for name, at in (kinds or ROUTINES).items()]
    return days.select("*", F.inline(F.concat(*each)))


#: Milliseconds after the event of a meter reading's stages; statuses and names of one.
READING = {"sent": 0, "recv": 60, "accept": 70, "apply": 80, "response": 90, "expire": 300_000}
READING_CONSTANTS = {
    "asset_type": "PCC", "destination_system_id": "DERMS-001", "source_role": "DER_Client", "destination_role": "DERMS", "command_type": "meter_reading", "authn_status": "passed", "authz_status": "passed", "integrity_status": "passed",
    "availability_status": "normal", "confidentiality_status": "passed", "delivery_status": "delivered", "communication_outcome": "success", "cia_dimension": "none", "message_type": "DER_METER_READING", "cyber_event_category": "metering", "lifecycle_stage": "DER_METER_READING",
    "related_physical_variable": "pcc_p_kw", "scenario_id": "metering_background",
}
READING_NUMBERS = {"target_pf": 1.0, "applied_pf": 1.0, "delay_s": 0.0, "network_latency_ms": 30.0, "processing_latency_ms": 10.0, "queue_latency_ms": 5.0, "total_delay_s": 0.045}
READING_FLAGS = ("retry_count", "timeout_flag", "duplicate_flag", "stale_command_flag", "replay_flag", "blocked_flag", "mismatch_flag", "label_anomaly", "label_cyber_anomaly", "label_physical_anomaly", "lifecycle_order", "is_control_event", "is_status_event", "is_security_event")


def meter_readings(rows: DataFrame, asset: str, time: str, p: str, q: str, overrides: dict[str, Column] | None = None) -> DataFrame:
    """One reading of a meter for each row; ``overrides`` (such as a scenario's labels) replace what a background reading says."""
    ident = message_id(F.col(asset), F.col(time))
    made = {"message_mrid": ident, "session_id": F.substring(ident, 1, 8), "asset_id": F.col(asset), "source_system_id": F.concat(F.lit("DER-"), F.col(asset)), "time_s": F.col(time), "is_monitoring_event": F.lit(1)}
    made |= {f"command_{stage}_time_ms": F.col(time) * 1000 + ms for stage, ms in READING.items()}
    made |= {f"{side}_{unit}": F.col(c).cast("double") for side in ("target", "applied") for unit, c in (("p_kw", p), ("q_kvar", q))}
    made |= {k: F.lit(v) for k, v in (READING_CONSTANTS | READING_NUMBERS).items()} | {k: F.lit(0) for k in READING_FLAGS}
    made |= overrides or {}
    return rows.select(*[c.alias(name) for name, c in made.items()])
