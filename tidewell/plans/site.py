"""Site telemetry, scenarios and evidence, with their SQL. The telemetry comes from its time axis alone, without noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bundles, explain, lifecycle, quality, scenarios, telemetry
from ..sources.readers import table
from .timeseries import _E, _events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


_NUMBERS = ("irradiance_pu", "temperature_c", "load_kw", "pv_p_kw", "bess_p_kw", "pcc_p_kw", "pcc_q_kvar", "pcc_v_a_pu", "pcc_i_a_amp", "feeder_head_p_kw", "line_loading_max_percent")


def _axis(spark, d: str, step: int) -> DataFrame:
    """The steps in which the log has events."""
    return _events(spark, d).select((F.floor(F.col("t") / step) * step).alias("time_s")).distinct()


def _profile_sql(step: int) -> str:
    return f"""{_E}, b AS (SELECT DISTINCT t // {step} * {step} AS time_s, t // {step} * {step} % 86400 AS tod, t // {step} * {step} // 86400 AS day FROM e),
s AS (SELECT *, CASE WHEN tod BETWEEN 21600 AND 64800 THEN sin(pi() * (tod - 21600) / 43200.0) ELSE 0 END * [0.92, 0.85, 0.97, 0.78, 0.90, 0.95, 0.82][day % 7 + 1] AS irradiance_pu,
least(45.0, greatest(-5.0, [15.0, 12.0, 18.0, 10.0, 16.0, 20.0, 14.0][day % 7 + 1] + 8 * sin(pi() * (tod / 86400.0 - 0.25)))) AS temperature_c,
least(160.0, greatest(20.0, CASE WHEN day % 7 >= 5 THEN 55.0 ELSE 80.0 END + 40 * least(1.0, greatest(0.0, sin(pi() * (tod - 21600) / 14400.0))) + 50 * least(1.0, greatest(0.0, sin(pi() * (tod - 54000) / 18000.0))))) AS load_kw FROM b),
p AS (SELECT *, irradiance_pu * 100.0 AS pv_p_kw, CASE WHEN tod >= 61200 AND tod < 75600 THEN 35.0 WHEN tod >= 36000 AND tod < 50400 AND irradiance_pu > 0.5 THEN -35.0 * irradiance_pu ELSE 0 END AS bess_p_kw FROM s),
q AS (SELECT *, load_kw - pv_p_kw - bess_p_kw AS pcc_p_kw, least(1.1, greatest(0.9, 1.0 + (pv_p_kw + bess_p_kw - load_kw) * 0.00015)) AS v, load_kw * tan(acos(0.87)) AS pcc_q_kvar, load_kw * 8 - pv_p_kw * 0.8 AS feeder_head_p_kw FROM p),
c AS (SELECT *, v AS pcc_v_a_pu, least(500.0, abs(pcc_p_kw) / (sqrt(3) * v * 0.48 + 1e-9) * 1000) AS pcc_i_a_amp, least(150.0, abs(pcc_p_kw) / (sqrt(3) * v * 0.48 + 1e-9) * 1000 / 200.0 * 100.0) AS line_loading_max_percent FROM q)"""


@_query(f"WITH {_profile_sql(300)} SELECT time_s, {', '.join(f'round({n}, 6) AS {n}' for n in _NUMBERS)}, (CASE WHEN v < 0.97 THEN 1 ELSE 0 END) AS capacitor_status, strftime(TIMESTAMP '2024-01-01' + to_seconds(time_s), '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc FROM c")
def site_profile(spark, d):
    """One site in each five minutes that have events: weather, load, dispatch and the electrical model."""
    made = telemetry.profile(spark, 0, axis=_axis(spark, d, 300), noisy=False)
    return made.select("time_s", *[F.round(n, 6).alias(n) for n in _NUMBERS], "capacitor_status", "timestamp_utc")


@_query(f"""WITH RECURSIVE {_profile_sql(300)}, n AS (SELECT time_s, bess_p_kw, row_number() OVER (ORDER BY time_s) AS i FROM c),
l AS (SELECT 0::BIGINT AS i, -1::BIGINT AS time_s, NULL::DOUBLE AS soc, 50.0::DOUBLE AS x UNION ALL
SELECT n.i, n.time_s, l.x, least(90.0, greatest(10.0, least(90.0, greatest(10.0, l.x + 100 * CASE WHEN bess_p_kw < 0 THEN -bess_p_kw * 0.95 ELSE -bess_p_kw / 0.95 END / 3600 / 200.0)) - 100 * 0.0001 / 3600)) FROM l JOIN n ON n.i = l.i + 1)
SELECT time_s, round(soc, 6) AS bess_soc_percent FROM l WHERE i > 0""")
def site_charge(spark, d):
    """State of charge before each five minutes that have events."""
    rows = telemetry.profile(spark, 0, axis=_axis(spark, d, 300), noisy=False).select("time_s", "bess_p_kw").withColumn("site", F.lit("a"))
    return telemetry.charge_series(rows, telemetry.Site(), ["site"]).select("time_s", F.round("bess_soc_percent", 6).alias("bess_soc_percent"))


#: (id, effect, start, end, size, size2, delay): every effect once on the first day.
_FX = (("a", "irradiance_drop", 40_000, 41_000, 0.5, 0.0, 0), ("b", "load_step", 42_000, 43_000, 40.0, 0.0, 0), ("c", "delayed_limit", 44_000, 45_200, 10.0, 0.0, 600), ("d", "voltage_sag", 46_000, 47_000, 0.1, 0.0, 0), ("e", "wrong_direction", 48_000, 49_000, 20.0, 0.0, 0),
       ("f", "soc_violation", 50_000, 51_000, 0.0, 0.0, 0), ("g", "oscillation", 51_000, 51_600, 0.0, 0.0, 0), ("h", "wrong_setpoint", 52_000, 52_600, 5.0, 60.0, 0), ("i", "stale_setpoint", 53_000, 53_600, 12.0, 0.0, 0))


@_query(f"""WITH {_profile_sql(60)}, f(id, effect, s, e, size, size2, delay) AS (VALUES {', '.join(map(str, _FX))}),
j AS (SELECT c.*, f.* EXCLUDE (s), s AS fs FROM c LEFT JOIN f ON time_s >= s AND time_s < e AND (effect <> 'delayed_limit' OR time_s >= s + delay)),
k AS (SELECT *, CASE WHEN effect = 'irradiance_drop' THEN irradiance_pu * size * 100 ELSE pv_p_kw END AS available,
CASE WHEN effect = 'irradiance_drop' THEN pv_p_kw WHEN effect IN ('delayed_limit', 'wrong_setpoint', 'stale_setpoint') THEN size WHEN effect = 'oscillation' THEN 100 * CASE WHEN ((time_s - fs) // 5) % 2 = 0 THEN 0.8 ELSE 0.2 END END AS wanted FROM j),
m AS (SELECT *, CASE WHEN wanted IS NULL THEN pv_p_kw ELSE least(wanted, available) END AS pv2, CASE WHEN effect = 'wrong_direction' THEN -size WHEN effect = 'soc_violation' THEN 50.0 ELSE bess_p_kw END AS bess2,
CASE WHEN effect = 'load_step' THEN pcc_p_kw + size ELSE pcc_p_kw END AS pcc2, CASE WHEN effect = 'voltage_sag' THEN least(1.15, greatest(0.5, v - size)) ELSE v END AS v2 FROM k)
SELECT time_s, coalesce(id, 'clean_baseline') AS physical_scenario_id, coalesce(effect, 'none') AS physical_effect_type, round(pv2, 6) AS pv_p_kw, round(greatest(available - pv2, 0), 6) AS pv_curtailment_kw, round(bess2, 6) AS bess_p_kw, round(v2, 8) AS pcc_voltage_mean_pu,
round(CASE WHEN effect = 'load_step' THEN least(500.0, abs(pcc2) / (sqrt(3) * v2 * 0.48 + 1e-9) * 1000) WHEN effect = 'voltage_sag' THEN least(800.0, pcc_i_a_amp / v2) ELSE pcc_i_a_amp END, 6) AS pcc_i_a_amp,
round(CASE WHEN effect = 'wrong_setpoint' THEN size2 WHEN effect = 'delayed_limit' THEN size ELSE pv_p_kw END, 6) AS pv_commanded_p_kw, round(pcc2 - pcc_p_kw, 6) AS delta_pcc_p_kw, round(v2 - v, 8) AS delta_pcc_v_a_pu, round(pv2 - pv_p_kw, 6) AS delta_pv_p_kw,
abs(pv2 - pv_p_kw) > 0.01 AS moved FROM m""")
def site_attacked(spark, d):
    """Minutes with events under every effect, and their residuals against the clean ones."""
    clean = telemetry.profile(spark, 0, axis=_axis(spark, d, 60), noisy=False)
    fx = spark.createDataFrame(_FX, "scenario_id string, effect string, start_s long, end_s long, size double, size2 double, delay_s long")
    attacked = telemetry.disturb(clean, fx)
    made = telemetry.residuals(clean, attacked, ["pcc_p_kw", "pcc_v_a_pu", "pv_p_kw"], context=["physical_scenario_id", "physical_effect_type", "pv_curtailment_kw", "bess_p_kw", "pcc_voltage_mean_pu", "pcc_i_a_amp", "pv_commanded_p_kw"])
    made = made.join(attacked.select("time_s", "pv_p_kw"), "time_s")
    return made.select("time_s", "physical_scenario_id", "physical_effect_type", *[F.round(c, 8 if "pcc_v" in c else 6).alias(c) for c in ("pv_p_kw", "pv_curtailment_kw", "bess_p_kw", "pcc_voltage_mean_pu", "pcc_i_a_amp", "pv_commanded_p_kw", "delta_pcc_p_kw", "delta_pcc_v_a_pu", "delta_pv_p_kw")], (F.abs("delta_pv_p_kw") > 0.01).alias("moved"))


@_query(f"""WITH {_profile_sql(300)}, r(check_name, violations, severity) AS (SELECT * FROM (SELECT 'row_count', abs(count(*) - 2016)::BIGINT, 'FAIL' FROM c UNION ALL SELECT 'unique_time_s', count(*) - count(DISTINCT time_s), 'FAIL' FROM c UNION ALL
SELECT 'no_gaps', count(*) FILTER (x - time_s <> 300), 'FAIL' FROM (SELECT time_s, lead(time_s) OVER (ORDER BY time_s) AS x FROM c) UNION ALL SELECT 'start_timestamp', (min(time_s) <> 0)::BIGINT, 'FAIL' FROM c UNION ALL SELECT 'end_timestamp', (max(time_s) <> 604500)::BIGINT, 'FAIL' FROM c UNION ALL
SELECT 'has_time_s', 0, 'FAIL' UNION ALL SELECT 'has_bess_soc_percent', 1, 'FAIL' UNION ALL SELECT 'pv_not_exceed_available', 0, 'FAIL' UNION ALL SELECT 'pv_apparent_power_limit', count(*) FILTER (pv_p_kw > 90.5), 'FAIL' FROM c UNION ALL
SELECT 'bess_apparent_power_limit', count(*) FILTER (abs(bess_p_kw) > 30.5), 'FAIL' FROM c UNION ALL SELECT 'voltage_plausible', count(*) FILTER (v < 0.85 OR v > 1.15), 'WARN' FROM c UNION ALL SELECT 'voltage_unbalance', 0, 'FAIL' UNION ALL
SELECT 'no_generic_rating', 0, 'FAIL' UNION ALL SELECT 'methods_allowed', count(*) FILTER (time_s % 7 = 0), 'FAIL' FROM c) t)
SELECT check_name, violations, CASE WHEN violations = 0 THEN 'PASS' ELSE severity END AS status FROM r""")
def physics_suite(spark, d):
    """Every physical check on telemetry whose ratings are set too low, whose axis has gaps and whose methods are partly unknown."""
    rows = telemetry.profile(spark, 0, axis=_axis(spark, d, 300), noisy=False, base="2024-01-01 00:00:00").withColumns({"generation_method": F.when(F.col("time_s") % 7 == 0, "guess").otherwise("surrogate"), "pv_s_rated_kva": F.lit(110.0)})
    site = telemetry.Site(pv_kva=90.0, storage_kva=30.0)
    return quality.physics_suite(rows, site, 2016, 300, ("2024-01-01T00:00:00", "2024-01-07T23:55:00"), ["time_s", "bess_soc_percent"], ["surrogate"])


_KINDS = ("normal", "physical_only", "cyber_only", "cyber_physical")
_FAMILIES = bundles.FAMILIES
_SC = f"""sc AS (SELECT o_orderkey AS scenario_id, {list(_KINDS)}[o_orderkey % 4 + 1] AS scenario_class, ['normal_control_variation', 'soc_aware_bess_dispatch_anomaly', 'pv_curtailment_mismatch', 'stale_or_delayed_measurement', 'command_delay', 'command_suppression',
'oscillatory_bess_control', 'pcc_voltage_deviation', 'coordinated_pv_bess_response', 'false_data_injection_context_only', 'availability_degradation_context_only', 'physical_irradiance_like_disturbance'][o_orderkey // 4 % 12 + 1] AS scenario_family,
(o_orderkey * 37 % 604000)::BIGINT AS start_time_s, (60 + o_orderkey % 1741)::BIGINT AS duration_s, (o_orderkey % 90)::BIGINT AS ramp_s FROM orders),
sd AS (SELECT *, start_time_s + duration_s - 1 AS e, start_time_s + duration_s // 2 AS mid, CASE WHEN contains(scenario_family, 'delay') THEN greatest(30, CASE WHEN ramp_s > 0 THEN ramp_s ELSE duration_s // 4 END) ELSE 0 END AS delay FROM sc)"""


def _scenarios(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    return table(spark, d, "orders").select(k.alias("scenario_id"), pick(_KINDS, k % 4).alias("scenario_class"), pick(_FAMILIES, F.floor(k / 4) % 12).alias("scenario_family"), (k * 37 % 604_000).cast("long").alias("start_time_s"),
                                            (60 + k % 1741).cast("long").alias("duration_s"), (k % 90).cast("long").alias("ramp_s"))


def _stage_rows() -> str:
    cyber = "scenario_class = 'cyber_only'"
    block, delay = "contains(scenario_family, 'suppres')", "contains(scenario_family, 'delay')"
    stale, false, lost = "contains(scenario_family, 'stale')", "contains(scenario_family, 'false_data')", "contains(scenario_family, 'availability')"
    s = "start_time_s"
    cases = [
        ("scenario_class = 'normal'", [("status_report", s, 0, 0), ("monitoring_complete", "e", 0, 0)]),
        ("scenario_class = 'physical_only'", [("monitoring_pre_event", s, 0, 0), ("physical_event_observed", f"{s} + greatest(ramp_s, 1)", 0, 1), ("monitoring_post_event", "e", 0, 1)]),
        (f"{cyber} AND {block}", [("command_created", f"{s} - 4", 1, 0), ("command_sent", s, 1, 0), ("command_blocked", s, 1, 0), ("security_alert_active", "mid", 1, 0)]),
        (f"{cyber} AND {delay} AND NOT {block}", [("command_created", f"{s} - 4", 1, 0), ("command_sent", s, 1, 0), ("command_delay_observed", f"{s} + delay", 1, 0), ("timeout_flagged", "e", 1, 0)]),
        (f"{cyber} AND {stale} AND NOT {delay}", [("telemetry_received", s, 1, 0), ("stale_measurement_context", "mid", 1, 0), ("stale_measurement_resolved", "e", 1, 0)]),
        (f"{cyber} AND {false}", [("telemetry_sent", s, 1, 0), ("mismatch_detected_context", "mid", 1, 0)]),
        (f"{cyber} AND {lost}", [("status_request_sent", s, 1, 0), ("timeout_observed", "mid", 1, 0), ("availability_degraded", "e", 1, 0)]),
        (f"{cyber} AND NOT ({block} OR {delay} OR {stale} OR {false} OR {lost})", [("cyber_event_start", s, 1, 0), ("security_alert", "mid", 1, 0), ("cyber_event_end", "e", 1, 0)]),
        ("scenario_class = 'cyber_physical'", [("command_created", f"{s} - 5", 1, 0), ("command_sent", f"{s} - 4", 1, 0), ("command_received", f"{s} - 3", 1, 0), ("command_accepted", f"{s} - 2", 1, 0), ("command_applied", f"{s} + delay", 1, 1),
                                               ("physical_response_observed", f"{s} + greatest(ramp_s, duration_s // 3)", 1, 1), ("status_report", "e", 1, 1)]),
    ]
    return " UNION ALL ".join(f"SELECT scenario_id, {i} AS lifecycle_order, '{stage}' AS lifecycle_stage, least(604799, greatest(0, {at}))::BIGINT AS event_time_s, {c} AS cyber_active, {p} AS physical_active FROM sd WHERE {when}" for when, rows in cases for i, (stage, at, c, p) in enumerate(rows))


@_query(f"WITH {_SC} {_stage_rows()}")
def phase_lifecycles(spark, d):
    """Two to seven lifecycle rows a scenario, by its class and family."""
    return lifecycle.observed_stages(_scenarios(spark, d)).select("scenario_id", "lifecycle_order", "lifecycle_stage", "event_time_s", "cyber_active", "physical_active")


@_query(f"""WITH {_SC}, t AS (SELECT *, start_time_s + k * duration_s // 4 AS t FROM sd, range(0, 4) r(k)),
g AS (SELECT *, CASE scenario_class WHEN 'normal' THEN 'normal_monitoring' WHEN 'physical_only' THEN CASE WHEN t - start_time_s >= ramp_s THEN 'physical_event_observed' ELSE 'monitoring_pre_event' END WHEN 'cyber_only' THEN 'cyber_event_active'
ELSE CASE WHEN t < start_time_s + delay THEN 'command_pipeline' WHEN t < start_time_s + ramp_s + 1 THEN 'command_applied' ELSE 'physical_effect_active' END END AS stage FROM t)
SELECT scenario_id, t, stage, CASE WHEN scenario_class = 'normal' OR scenario_class = 'physical_only' AND stage <> 'physical_event_observed' THEN 'normal_monitoring' WHEN scenario_class = 'physical_only' THEN 'physical_event_observed'
WHEN contains(scenario_family, 'suppres') THEN 'blocked_command' WHEN contains(scenario_family, 'delay') THEN 'delayed_command_context' WHEN contains(scenario_family, 'stale') THEN 'stale_measurement_context'
WHEN contains(scenario_family, 'false_data') THEN 'false_data_context' WHEN contains(scenario_family, 'availability') THEN 'availability_degraded' WHEN scenario_class = 'cyber_physical' THEN 'cyber_physical_effect_active' ELSE 'security_event_active' END AS cyber_state FROM g""")
def second_states(spark, d):
    """Lifecycle stage and cyber state at four seconds of each scenario."""
    rows = _scenarios(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    rows = rows.withColumn("t", F.col("start_time_s") + F.floor(F.col("k") * F.col("duration_s") / 4))
    ramp = F.when(F.col("ramp_s") > 0, F.col("ramp_s")).otherwise(F.floor(F.col("duration_s") / 4))
    delay = F.when(F.col("scenario_family").contains("delay"), F.greatest(F.lit(30), ramp)).otherwise(0)
    stage = lifecycle.stage_at(F.col("scenario_class"), F.col("t"), F.col("start_time_s"), F.col("ramp_s"), F.col("start_time_s") + delay)
    rows = rows.withColumn("stage", stage)
    return rows.select("scenario_id", "t", "stage", scenarios.cyber_state(F.col("scenario_class"), F.col("scenario_family"), F.col("stage")).alias("cyber_state"))


@_query(f"""WITH {_SC}, x AS (SELECT *, CASE WHEN scenario_id % 5 = 0 THEN NULL ELSE start_time_s + delay END AS applied, start_time_s - 4 AS sent, start_time_s + 30 * (scenario_id % 9) AS t FROM sd),
y AS (SELECT *, coalesce(applied, sent) AS anchor, (t BETWEEN start_time_s AND e)::INT AS physical_effect_active_flag FROM x)
SELECT scenario_id, (t BETWEEN sent AND sent + 120)::INT AS cyber_active_flag, (t BETWEEN sent AND coalesce(applied + 60, sent + 120))::INT AS command_active_flag, physical_effect_active_flag,
(scenario_class <> 'normal' AND (physical_effect_active_flag = 1 OR t BETWEEN sent AND sent + 60))::INT AS attack_active_flag, greatest(0, start_time_s - 120) AS window_start_s, least(604799, e + 120) AS window_end_s,
(contains(scenario_family, 'delay') OR scenario_id % 6 = 0)::INT AS command_delay_active_flag, (contains(scenario_family, 'suppress') OR contains(scenario_family, 'block') OR scenario_id % 6 = 1)::INT AS blocked_flag, (contains(scenario_family, 'false_data') OR contains(scenario_family, 'mismatch') OR contains(scenario_family, 'oscillatory'))::INT AS mismatch_flag,
(contains(scenario_family, 'stale'))::INT AS stale_command_flag, (contains(scenario_family, 'availability'))::INT AS timeout_flag FROM y""")
def context_flags(spark, d):
    """Flags of one second beside each scenario, its context window, and what its family and delivery imply."""
    c = F.col
    ramp = F.when(c("ramp_s") > 0, c("ramp_s")).otherwise(F.floor(c("duration_s") / 4))
    delay = F.when(c("scenario_family").contains("delay"), F.greatest(F.lit(30), ramp)).otherwise(0)
    rows = _scenarios(spark, d).withColumns({
        "apply_s": F.when(c("scenario_id") % 5 != 0, c("start_time_s") + delay), "sent_s": c("start_time_s") - 4, "t": c("start_time_s") + 30 * (c("scenario_id") % 9), "effect_start_s": c("start_time_s"), "effect_end_s": c("start_time_s") + c("duration_s") - 1,
        "delivery": F.when(c("scenario_id") % 6 == 0, "delayed").when(c("scenario_id") % 6 == 1, "blocked").otherwise("success"),
    })
    rows = scenarios.context_bounds(rows)
    made = scenarios.context_flags(c("t"), c("sent_s"), c("apply_s"), c("effect_start_s"), c("effect_end_s"), c("sent_s"), c("scenario_class") != "normal")
    implied = scenarios.family_flags(c("scenario_family"), c("delivery"))
    names = ("command_delay_active_flag", "blocked_flag", "mismatch_flag", "stale_command_flag", "timeout_flag")
    return rows.select("scenario_id", *[x.alias(n) for n, x in made.items()], "window_start_s", "window_end_s", *[implied[n].alias(n) for n in names])


@_query(f"""WITH {_SC} SELECT scenario_id, greatest(0, least(start_time_s + 299, e) - greatest(start_time_s - 60, start_time_s) + 1) AS shared_s, CASE scenario_class WHEN 'normal' THEN 'no_anomaly' WHEN 'physical_only' THEN 'physical_only_no_cyber_event' WHEN 'cyber_only' THEN 'cyber_only_no_physical_effect'
ELSE CASE scenario_id % 3 WHEN 0 THEN 'cyber_physical_timing_unknown' WHEN 1 THEN 'cyber_before_physical_confirmed' ELSE 'cyber_physical_simultaneous' END END AS timing_alignment_status, (start_time_s + e) // 2 AS peak_s,
CASE WHEN scenario_id % 2 = 0 THEN 'Physical effect active ' || (20 + scenario_id % 50) || '% of window.' ELSE 'No significant deviation observed.' END AS observed,
CASE scenario_class WHEN 'normal' THEN 'Expected normal — no significant deviation observed.' WHEN 'physical_only' THEN 'Expected physical change with no cyber cause.' WHEN 'cyber_only' THEN 'Expected cyber anomaly with no physical signal change.' ELSE 'Expected cyber event followed by physical signal change.' END AS difference FROM sd""")
def expected_and_observed(spark, d):
    """Timing and wording of each scenario's detection."""
    from ..operators.intervals import overlap_seconds

    c = F.col
    end, start = c("start_time_s") + c("duration_s") - 1, c("start_time_s")
    effect = F.when(c("scenario_id") % 3 == 1, start).when(c("scenario_id") % 3 == 2, start - 9)
    share = F.when(c("scenario_id") % 2 == 0, (20 + c("scenario_id") % 50) / 100).otherwise(0.05)
    said = explain.expected_and_observed(c("scenario_class"), share, F.lit(0.0), F.lit(None).cast("struct<signal:string,mean:double,std:double,delta:double>"))
    return _scenarios(spark, d).select("scenario_id", overlap_seconds(start - 60, start + 299, start, end).alias("shared_s"), explain.alignment_status(c("scenario_class"), start, effect).alias("timing_alignment_status"),
                                       F.floor((start + end) / 2).alias("peak_s"), said["observed_behavior_summary"].alias("observed"), said["expected_vs_observed_difference"].alias("difference"))


@_query(f"""WITH {_E}, d AS (SELECT k AS detection_id, k * 86400 AS s, k * 86400 + 3599 AS x FROM (SELECT unnest(range(0, max(t) // 86400 + 11)) AS k FROM e)),
j AS (SELECT d.detection_id, event_type, user_id % 3 AS u, (event_type = 'error')::INT AS a, (value > 80)::INT AS b, (value < 0)::INT AS r FROM d JOIN e ON t BETWEEN s AND x),
g AS (SELECT detection_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS states, string_agg(DISTINCT 's' || u, ',' ORDER BY 's' || u) AS stages, round(avg(a), 4) AS cyber_fraction, round(avg(b), 4) AS blocked_flag_fraction, max(b) > 0 AS blocked_flag_seen, max(r) > 0 AS replay_flag_seen FROM j GROUP BY 1)
SELECT d.detection_id, states, stages, cyber_fraction, blocked_flag_fraction, blocked_flag_seen, replay_flag_seen, states IS NOT NULL AS cyber_evidence_available FROM d LEFT JOIN g ON g.detection_id = d.detection_id""")
def cyber_windows(spark, d):
    """States, stages and flags seen in each detection's window; windows beyond the log have no evidence."""
    aligned = _events(spark, d).select(F.col("t").alias("time_s"), F.col("event_type").alias("cyber_state"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("cyber_lifecycle_stage"), (F.col("event_type") == "error").cast("int").alias("cyber_anomaly_active"),
                                       (F.col("value") > 80).cast("int").alias("blocked_flag"), (F.col("value") < 0).cast("int").alias("replay_flag"))
    days = (_events(spark, d).agg(F.max("t")).first()[0] or 0) // 86_400 + 11
    hits = spark.range(days).select(F.col("id").alias("detection_id"), (F.col("id") * 86_400).alias("window_start_s"), (F.col("id") * 86_400 + 3599).alias("window_end_s"))
    made = explain.cyber_evidence(hits, aligned, ["blocked_flag", "replay_flag"], 3600)
    text = lambda c: F.when(F.col(c).isNotNull(), F.array_join(c, ","))
    return made.select("detection_id", text("cyber_states_seen").alias("states"), text("lifecycle_stages_seen").alias("stages"), "cyber_fraction", "blocked_flag_fraction", "blocked_flag_seen", "replay_flag_seen", "cyber_evidence_available")


@_query(f"""WITH {_E}, v AS (SELECT user_id, floor(value) AS value FROM e), w AS (SELECT user_id, max(abs(value)) AS p, min(value) AS lo, max(value) AS hi, max(abs(value / 10000)) AS v, round(avg(value), 3) AS a, round(avg(value - 1), 3) AS b FROM v GROUP BY 1)
SELECT user_id AS scenario_id, 'pv_apparent_power_limit' AS "constraint", CASE WHEN p <= 110 THEN 'pass' ELSE 'fail' END AS status, round(p, 2) AS "value", a AS actual, b AS baseline FROM w UNION ALL SELECT user_id, 'bess_soc_min', CASE WHEN lo >= 9.5 THEN 'pass' ELSE 'fail' END, round(lo, 2), a, b FROM w
UNION ALL SELECT user_id, 'bess_soc_max', CASE WHEN hi <= 90.5 THEN 'pass' ELSE 'fail' END, round(hi, 2), a, b FROM w UNION ALL SELECT user_id, 'voltage_residual_threshold', CASE WHEN v < 0.05 THEN 'pass' ELSE 'warning' END, round(v, 4), a, b FROM w""")
def constraint_evidence(spark, d):
    """Checks of each scenario's window against its limits, beside the means of its signals, out of one packet."""
    v = F.floor("value").cast("double")
    columns = {f"{k}_{s}": x for s in ("p_kw", "q_kvar", "voltage_pu", "soc_percent") for k, x in (("baseline", v - 1), ("actual", v), ("residual", v / 10_000 if s == "voltage_pu" else F.lit(1.0)))}
    rows = _events(spark, d).select(F.col("user_id").alias("scenario_id"), *[x.alias(n) for n, x in columns.items()])
    both = scenarios.constraint_checks(rows).join(scenarios.physical_evidence(rows), "scenario_id")
    first = F.col("evidence")[0]
    return both.select("scenario_id", first["actual"].alias("actual"), first["baseline"].alias("baseline"), F.inline("checks")).select("scenario_id", "constraint", "status", "value", "actual", "baseline")


@_query(f"""WITH {_SC}, a AS (SELECT *, CASE WHEN scenario_id % 7 = 0 THEN 'normal' ELSE scenario_class END AS said, CASE WHEN scenario_id % 5 = 0 THEN 'feeder' ELSE 'the pv_001 inverter' END AS asset, scenario_id % 3 AS m, scenario_id % 11 <> 0 AS ok FROM sd),
c AS (SELECT scenario_id, ok, (ok AND said = scenario_class)::INT AS c1, (ok AND asset <> 'feeder')::INT AS c2, (scenario_class NOT IN ('physical_only', 'cyber_physical') OR ok AND m = 0)::INT AS c3, (scenario_class NOT IN ('cyber_only', 'cyber_physical') OR ok AND m = 1)::INT AS c4,
(ok AND (scenario_class = 'normal'))::INT AS c5, (ok AND m = 2)::INT AS c6, (ok AND (m = 0 OR m = 1))::INT AS c7, (ok AND (m = 0 OR m = 1))::INT AS c8, (ok AND (scenario_class = 'normal' OR scenario_class IN ('cyber_only', 'cyber_physical') AND m = 1 ))::INT AS c9, (ok AND scenario_class <> 'normal' AND m = 0 OR ok AND scenario_class = 'normal' AND m <> 0)::INT AS c10,
(m = 2)::INT AS p1, (scenario_id % 13 = 0)::INT AS p2 FROM a) SELECT scenario_id, (c1 + c2 + c3 + c4 + c5 + c6 + c7 + c8 + c9 + c10)::BIGINT AS met, c1 AS class_match, c4 AS cyber_match, c9 AS timing_relationship, round(CASE WHEN ok THEN greatest(0, least(1, (c1 + c2 + c3 + c4 + c5 + c6 + c7 + c8 + c9 + c10) / 10 - 0.15 * (p1 + p2))) ELSE 0 END, 4) AS overall FROM c""")
def explanation_checks(spark, d):
    """Ten checks and five penalties of made-up explanations, and their score."""
    c, m = F.col, F.col("scenario_id") % 3
    rows = _scenarios(spark, d)
    none = F.array().cast("array<string>")
    answer = {
        "type": F.when(c("scenario_id") % 7 == 0, "normal").otherwise(c("scenario_class")), "asset": F.when(c("scenario_id") % 5 == 0, "feeder").otherwise("the pv_001 inverter"), "signals": F.when(m == 0, F.array(F.lit("pv_p_kw"))).otherwise(none), "fields": none,
        "cyber": F.when(m == 1, F.array(F.lit("blocked_flag"))).otherwise(none), "timing_status": F.lit("no_anomaly"), "difference": F.when(m == 2, "The output fell far below what was expected.").otherwise("short"),
        "timing": F.when(c("scenario_class") == "normal", "No event was seen").when(m == 1, "A cyber event").otherwise("unclear"), "actions": F.when(m == 0, F.array(F.lit("Check PV_001 now"))).otherwise(none),
    }
    text = F.when(m == 0, "pv_p_kw fell").when(m == 1, "blocked_flag was up").otherwise("a packet was lost")
    parsed = c("scenario_id") % 11 != 0
    checks = explain.positive_checks(c("scenario_class"), F.lit("pv_001"), F.lit("pv_001"), F.array(F.lit("pv_p_kw")), answer, text, parsed)
    faults = explain.penalties(text, {"unsupported_claim_flag": c("scenario_id") % 13 == 0})
    met = sum(list(checks.values())[1:], next(iter(checks.values()))).cast("long")
    score = explain.overall_score(list(checks.values()), list(faults.values()), parsed, digits=4)
    return rows.select("scenario_id", met.alias("met"), checks["scenario_class_match"].alias("class_match"), checks["cyber_state_match"].alias("cyber_match"), checks["timing_relationship_correct"].alias("timing_relationship"), score.alias("overall"))


@_query(f"""WITH g AS (SELECT n_regionkey AS k, n_nationkey AS n, ['physical', 'cyber', 'context', 'files', 'figures'][n_nationkey // 5 + 1] AS gate, CASE WHEN (n_nationkey + n_regionkey) % 4 = 0 THEN 'FAIL' WHEN n_nationkey % 3 = 0 THEN 'WARN' ELSE 'PASS' END AS status FROM nation)
SELECT k, CASE WHEN bool_or(status = 'FAIL' AND gate <> 'figures') THEN 'FAIL' ELSE 'PASS' END AS overall, count(*) FILTER (status = 'FAIL' AND gate = 'figures') AS figure_warnings FROM g GROUP BY 1""")
def gate_overall(spark, d):
    """A failed gate fails the whole, but figures only warn."""
    n = F.col("n_nationkey")
    gate = F.element_at(F.array(*map(F.lit, ("physical", "cyber", "context", "files", "figures"))), (F.floor(n / 5) + 1).cast("int"))
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("k"), gate.alias("gate"), F.when((n + F.col("n_regionkey")) % 4 == 0, "FAIL").when(n % 3 == 0, "WARN").otherwise("PASS").alias("status"))
    return quality.gates(rows, ["k"], ["figures"])


@_query(f"""WITH {_SC} SELECT scenario_id, greatest(0, start_time_s - greatest(600, floor(1.5 * duration_s)::BIGINT)) AS slice_start_s, least(604799, e + greatest(600, floor(1.5 * duration_s)::BIGINT)) AS slice_end_s, round(ramp_s / 90.0 * 100)::BIGINT AS percent,
CASE WHEN ramp_s / 90.0 >= 0.8 THEN 'good' WHEN ramp_s / 90.0 >= 0.5 THEN 'fair' ELSE 'poor' END AS level FROM sd""")
def viewer_slices(spark, d):
    """Padded slices for charts, and scores as percents with their colour level."""
    rows = _scenarios(spark, d)
    end, share = F.col("start_time_s") + F.col("duration_s") - 1, F.col("ramp_s") / 90.0
    low, high = explain.padded(F.col("start_time_s"), end, F.col("duration_s"))
    return rows.select("scenario_id", low.alias("slice_start_s"), high.alias("slice_end_s"), *[x.alias(n) for n, x in explain.scorecard(share).items()])


#: Scenarios of a week, one a supplier, and the events of the log on the week's axis, each with the scenarios that hold its second.
_ALIGNED = f"""{_E}, mf AS (SELECT s_suppkey::BIGINT AS id, s_suppkey::BIGINT * 6047 % 600000 AS s, s_suppkey::BIGINT * 6047 % 600000 + 599 + s_suppkey * 37 % 1200 AS x, {list(_KINDS)}[s_suppkey % 4 + 1] AS kind, 'author' || s_suppkey % 5 AS author, CASE WHEN s_suppkey % 23 = 0 THEN 'pv35' ELSE 'pv_001' END AS asset FROM supplier),
h AS (SELECT event_id, t % 604800 AS t, count(id) AS n, min(id) AS id FROM e LEFT JOIN mf ON t % 604800 BETWEEN s AND x GROUP BY 1, 2),
al AS (SELECT h.*, CASE WHEN n = 0 THEN '' WHEN n = 1 THEN h.id::VARCHAR ELSE 'MULTIPLE' END AS sid, (CASE WHEN event_id % 41 = 0 THEN 1 - (n > 0)::INT ELSE (n > 0)::INT END) AS active, kind, author, asset, (coalesce(kind, '') IN ('cyber_only', 'cyber_physical') AND event_id % 7 <> 0)::INT AS ca,
(coalesce(kind, '') IN ('physical_only', 'cyber_physical') OR event_id % 13 = 0)::INT AS pa, event_id % 101 <> 0 AS elo, event_id % 103 = 0 AS plc FROM h LEFT JOIN mf ON mf.id = h.id)"""
_ALIGNED_CHECKS = [
    ("row_count", "abs(count(*) - 604800)", "FAIL"), ("time_s_min", "abs(min(t))", "FAIL"), ("time_s_max", "abs(max(t) - 604799)", "FAIL"), ("unique_time_s", "count(*) - count(DISTINCT t)", "FAIL"), ("authors_represented", "greatest(0, 6 - count(DISTINCT author) FILTER (active = 1))", "FAIL"),
    ("old_assets", "count(*) FILTER (asset = 'pv35')", "FAIL"), ("event_level_only", "count(*) FILTER (NOT elo)", "FAIL"), ("packet_claims", "count(*) FILTER (plc)", "FAIL"), ("normal_without_cyber", "count(*) FILTER (active = 1 AND sid <> 'MULTIPLE' AND kind = 'normal' AND ca <> 0)", "FAIL"),
    *[(f"{name}", f"count(*) FILTER (active = 1 AND sid <> 'MULTIPLE' AND kind = '{kind}' AND {flag} <> {value})", "FAIL") for name, kind, flag, value in (("normal_without_physical", "normal", "pa", 0), ("cyber_only_without_physical", "cyber_only", "pa", 0), ("physical_only_without_cyber", "physical_only", "ca", 0), ("cyber_physical_with_cyber", "cyber_physical", "ca", 1), ("cyber_physical_with_physical", "cyber_physical", "pa", 1))],
    ("active_where_covered", "count(*) FILTER ((n > 0) <> (active = 1))", "FAIL"), ("multiple_where_overlapping", "count(*) FILTER ((n > 1) <> (sid = 'MULTIPLE'))", "FAIL"),
]


@_query(f"""WITH {_ALIGNED}, r(check_name, violations, severity) AS (
{' UNION ALL '.join(f"SELECT '{name}', ({violations})::BIGINT, '{severity}' FROM al" for name, violations, severity in _ALIGNED_CHECKS)}
UNION ALL SELECT 'log_ids_in_manifest', count(DISTINCT user_id)::BIGINT, 'FAIL' FROM e WHERE user_id NOT IN (SELECT id FROM mf) UNION ALL SELECT 'manifest_scenarios', abs(count(DISTINCT id) - 64)::BIGINT, 'WARN' FROM mf
UNION ALL SELECT 'scenarios_represented', count(*)::BIGINT, 'WARN' FROM mf WHERE id::VARCHAR NOT IN (SELECT sid FROM al WHERE active = 1))
SELECT check_name, violations, CASE WHEN violations = 0 THEN 'PASS' ELSE severity END AS status FROM r""")
def alignment_suite(spark, d):
    """A log aligned with scenarios, with some flags wrong, held against both its sides."""
    from ..operators.intervals import Interval, inside

    k = F.col("s_suppkey").cast("long")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    manifest = table(spark, d, "supplier").select(k.cast("string").alias("scenario_id"), k.alias("id"), (k * 6047 % 600_000).alias("start_time_s"), (k * 6047 % 600_000 + 599 + k * 37 % 1200).alias("end_time_s"), pick(_KINDS, k % 4).alias("scenario_class"),
                                                  F.concat(F.lit("author"), (k % 5).cast("string")).alias("author_model"), F.when(k % 23 == 0, "pv35").otherwise("pv_001").alias("target_asset_id"))
    events = _events(spark, d).select("event_id", (F.col("t") % 604_800).alias("time_s"))
    held = inside(events, "time_s", manifest, Interval("start_time_s", "end_time_s", True), 3600).groupBy("event_id").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    rows = events.join(held, "event_id", "left").join(manifest.select("id", "scenario_class", "author_model", "target_asset_id"), "id", "left").fillna(0, ["n"])
    e, n, kind = F.col("event_id"), F.col("n"), F.coalesce("scenario_class", F.lit(""))
    aligned = rows.select(
        "time_s", F.when(e % 41 == 0, 1 - (n > 0).cast("int")).otherwise((n > 0).cast("int")).alias("zero_day_active_flag"), F.when(n == 0, "").when(n == 1, F.col("id").cast("string")).otherwise("MULTIPLE").alias("scenario_id"), "scenario_class", "author_model", "target_asset_id",
        (kind.isin("cyber_only", "cyber_physical") & (e % 7 != 0)).cast("int").alias("cyber_anomaly_active"), (kind.isin("physical_only", "cyber_physical") | (e % 13 == 0)).cast("int").alias("physical_effect_active"),
        (e % 101 != 0).cast("int").alias("event_level_only"), (e % 103 == 0).cast("int").alias("packet_level_protocol_compliance_claimed"),
    )
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("scenario_id"))
    return quality.alignment_suite(aligned, log, manifest, 604_800, 64, 6, ["pv35", "bess48"])


@_query(f"""WITH {_ALIGNED}, c AS (SELECT *, t - s AS since, event_id % 211 = 0 AS bare FROM al LEFT JOIN (SELECT id, s FROM mf) m USING (id)), r(check_name, violations, severity) AS (
SELECT 'has_cyber_active_flag', 0::BIGINT, 'FAIL' UNION ALL SELECT 'has_command_active_flag', 1, 'FAIL' UNION ALL SELECT 'has_physical_effect_active_flag', 0, 'FAIL' UNION ALL SELECT 'has_attack_active_flag', 0, 'FAIL' UNION ALL SELECT 'has_generation_method', 0, 'FAIL' UNION ALL SELECT 'has_protocol_claim_level', 0, 'FAIL'
UNION ALL SELECT 'attack_flag_not_all_rows', (avg(active) >= 0.5)::BIGINT, 'WARN' FROM c UNION ALL SELECT 'cyber_only_no_physical_flag', (avg(pa) FILTER (kind = 'cyber_only') > 0)::BIGINT, 'WARN' FROM c UNION ALL SELECT 'physical_only_no_malicious_cyber_flag', (avg(ca) FILTER (kind = 'physical_only') >= 0.2)::BIGINT, 'WARN' FROM c
UNION ALL SELECT 'delayed_physical_after_apply_time', count(*) FILTER (kind = 'cyber_physical' AND pa = 1 AND since - 300 < -5), 'FAIL' FROM c UNION ALL SELECT 'ctx_generation_method_no_null', count(*) FILTER (bare), 'WARN' FROM c UNION ALL SELECT 'ctx_protocol_claim_level_no_null', count(*) FILTER (kind IS NULL), 'WARN' FROM c
UNION ALL SELECT 'context_windows_not_empty', (count(*) = 0)::BIGINT, 'FAIL' FROM c) SELECT check_name, coalesce(violations, 0) AS violations, CASE WHEN coalesce(violations, 0) = 0 THEN 'PASS' ELSE severity END AS status FROM r""")
def context_causality(spark, d):
    """Context windows around scenarios: what their flags may not say, one column of them missing."""
    from ..operators.intervals import Interval, inside

    k, e = F.col("s_suppkey").cast("long"), F.col("event_id")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    spans = table(spark, d, "supplier").select(k.alias("id"), (k * 6047 % 600_000).alias("s"), (k * 6047 % 600_000 + 599 + k * 37 % 1200).alias("x"), pick(_KINDS, k % 4).alias("final_event_class"))
    events = _events(spark, d).select("event_id", (F.col("t") % 604_800).alias("time_s"))
    held = inside(events, "time_s", spans, Interval("s", "x", True), 3600).groupBy("event_id").agg(F.min("id").alias("id"))
    rows = events.join(held, "event_id", "left").join(spans, "id", "left")
    kind = F.coalesce("final_event_class", F.lit(""))
    active = F.col("id").isNotNull().cast("int")
    ctx = rows.select(
        "final_event_class", (kind.isin("cyber_only", "cyber_physical") & (e % 7 != 0)).cast("int").alias("cyber_active_flag"), (kind.isin("physical_only", "cyber_physical") | (e % 13 == 0)).cast("int").alias("physical_effect_active_flag"),
        F.when(e % 41 == 0, 1 - active).otherwise(active).alias("attack_active_flag"), F.when(e % 211 != 0, "surrogate").alias("generation_method"), F.when(F.col("id").isNotNull(), "event_level").alias("protocol_claim_level"),
        F.when(kind == "cyber_physical", "delayed_pv_limit").otherwise("none").alias("anomaly_type"), (F.col("time_s") - F.col("s") - 300).alias("relative_time_to_apply_s"),
    )
    return quality.context_suite(ctx)


@_query(f"""WITH {_E}, i AS (SELECT o_orderkey % 2592000 AS x, o_orderkey * 173 % 2592000 AS s, o_orderkey * 173 % 2592000 + o_orderkey % 3600 AS e FROM (SELECT o_orderkey::BIGINT AS o_orderkey FROM orders)) SELECT event_id, t, count(s) AS covering FROM e LEFT JOIN i ON t >= s AND t < i.e GROUP BY 1, 2""")
def covered_seconds(spark, d):
    """How many of the orders' intervals hold each event, without a row a second or a pair."""
    from ..operators.intervals import Interval, covering

    k = F.col("o_orderkey").cast("long")
    spans = table(spark, d, "orders").select((k * 173 % 2_592_000).alias("s"), (k * 173 % 2_592_000 + k % 3600).alias("e"))
    return covering(_events(spark, d).select("event_id", "t"), "t", spans, Interval("s", "e"))


#: Tries of a request; the axis has 20,000 seconds a customer.
_ROUNDS = 8


@_query(f"""WITH RECURSIVE q AS (SELECT c_custkey::BIGINT AS k, 300 + c_custkey::BIGINT * 97 % 1500 AS n, (SELECT count(*) FROM customer) * 20000 AS room FROM customer),
st AS (SELECT 0 AS turn, k, n, room, NULL::BIGINT AS s FROM q UNION ALL
SELECT turn + 1, k, n, room, CASE WHEN s IS NOT NULL THEN s WHEN blocked OR early THEN NULL ELSE p END FROM (
WITH w AS (SELECT *, ('0x' || substr(md5('0:' || turn || ':' || k), 1, 12))::BIGINT % (room - 1200 - n) + 600 AS p FROM st WHERE turn < {_ROUNDS}),
x AS (SELECT w.*, s IS NULL AND EXISTS (SELECT 1 FROM w z WHERE z.s IS NOT NULL AND z.s < w.p + w.n AND w.p < z.s + z.n) AS blocked FROM w)
SELECT x.*, EXISTS (SELECT 1 FROM x y WHERE NOT y.blocked AND y.s IS NULL AND y.k < x.k AND y.p < x.p + x.n AND x.p < y.p + y.n) AS early FROM x))
SELECT k AS request, n AS duration_s, s AS start_s FROM st WHERE turn = {_ROUNDS}""")
def placed_requests(spark, d):
    """A random place for each customer's request on one axis, without overlaps."""
    from ..operators.intervals import placed

    k = F.col("c_custkey").cast("long")
    customers = table(spark, d, "customer")
    requests = customers.select(k.alias("request"), (300 + k * 97 % 1500).alias("duration_s"))
    return placed(requests, "request", "duration_s", customers.count() * 20_000, tries=_ROUNDS)
