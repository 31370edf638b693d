"""Telemetry profiles, scenario effects, bundles and packets."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F
from tidewell.operators import bundles, scenarios, telemetry
from tidewell.operators.intervals import Interval, inside


def test_profile_without_noise(spark):
    df = telemetry.profile(spark, 2 * 86_400, step=900, noisy=False).cache()
    rows = {r.time_s: r for r in df.collect()}
    assert len(rows) == 192
    noon = rows[12 * 3600]
    assert noon.irradiance_pu == pytest.approx(0.92) and noon.pv_p_kw == pytest.approx(92.0)
    assert noon.bess_p_kw == pytest.approx(-0.7 * 50 * 0.92)
    assert rows[0].irradiance_pu == 0.0 and rows[18 * 3600].bess_p_kw == pytest.approx(35.0)
    load = 80 + 40 * max(0, math.sin(math.pi * 6 / 4)) + 0
    assert noon.load_kw == pytest.approx(min(160, max(20, load)))
    mean = 1 + (noon.pv_p_kw + noon.bess_p_kw - noon.load_kw) * 0.00015
    assert noon.pcc_voltage_mean_pu == pytest.approx(mean) and noon.voltage_unbalance_status == "normal"
    assert noon.pcc_p_kw == pytest.approx(noon.load_kw - noon.pv_p_kw - noon.bess_p_kw)


def test_noise_is_stable_and_centred(spark):
    df = spark.range(20_000).withColumnRenamed("id", "t")
    made = df.repartition(7).select(F.avg(telemetry.noise(F.col("t"), 5, 2.0)).alias("m"), F.stddev(telemetry.noise(F.col("t"), 5, 2.0)).alias("s")).first()
    assert abs(made.m) < 0.06 and made.s == pytest.approx(2.0, abs=0.06)
    noisy = telemetry.profile(spark, 7200 * 6, step=60)
    assert noisy.filter("irradiance_pu < 0 or irradiance_pu > 1").count() == 0


def test_charge_series_stays_inside(spark):
    rows = [("b", i, 50.0 if i < 4000 else -50.0) for i in range(9000)]
    df = spark.createDataFrame(rows, "k string, time_s long, bess_p_kw double")
    out = telemetry.charge_series(df, telemetry.Site(storage_kwh=40.0), ["k"]).orderBy("time_s").collect()
    soc = [r.bess_soc_percent for r in out]
    assert soc[0] == 50.0 and min(soc) == pytest.approx(10.0) and max(soc) == pytest.approx(90.0, abs=1e-3)
    assert soc[1] == pytest.approx(50 - 100 * (50 / 0.95 / 3600 + 0.0001 * 40 / 3600) / 40)


def test_effects_and_residuals(spark):
    clean = telemetry.profile(spark, 86_400, step=60, noisy=False).withColumn("bess_soc_percent", F.lit(11.0))
    rows = [("a", "irradiance_drop", 40_000, 41_000, 0.5, 0.0, 0), ("b", "load_step", 42_000, 43_000, 40.0, 0.0, 0), ("c", "delayed_limit", 44_000, 45_200, 10.0, 0.0, 600), ("d", "voltage_sag", 46_000, 47_000, 0.1, 0.0, 0),
            ("e", "wrong_direction", 48_000, 49_000, 20.0, 0.0, 0), ("f", "soc_violation", 50_000, 51_000, 0.0, 0.0, 0), ("g", "oscillation", 51_000, 51_600, 0.0, 0.0, 0), ("h", "wrong_setpoint", 52_000, 52_600, 5.0, 60.0, 0)]
    fx = spark.createDataFrame(rows, "scenario_id string, effect string, start_s long, end_s long, size double, size2 double, delay_s long")
    attacked = telemetry.disturb(clean, fx)
    assert attacked.count() == clean.count()
    delta = telemetry.residuals(clean, attacked, ["pv_p_kw", "pcc_p_kw", "bess_p_kw", "pcc_v_a_pu", "absent"], context=["physical_scenario_id", "pv_commanded_p_kw", "pv_p_kw", "soc_violation_flag", "bess_p_kw"])
    at = {r.time_s: r for r in delta.collect()}
    base = {r.time_s: r for r in clean.collect()}
    assert at[40_020].pv_p_kw == pytest.approx(base[40_020].pv_p_kw / 2) and at[40_020].physical_scenario_id == "a"
    assert at[42_000].delta_pcc_p_kw == pytest.approx(40.0) and at[43_020].delta_pcc_p_kw == 0.0
    assert at[44_400].delta_pv_p_kw == 0.0 and at[44_640].pv_p_kw == 10.0
    assert at[46_020].delta_pcc_v_a_pu == pytest.approx(-0.1)
    assert at[48_000].bess_p_kw == -20.0 and at[50_040].bess_p_kw == 0.0 and at[50_040].soc_violation_flag == 1
    assert (at[52_020].pv_p_kw, at[52_020].pv_commanded_p_kw) == (5.0, 60.0)
    assert all(r.delta_absent == 0.0 for r in at.values())


def bundle():
    classes = [c for c, k in bundles.CLASSES.items() for _ in range(k)]
    out = []
    for i, kind in enumerate(classes):
        effects = [{"variable": "pv_p_kw", "effect_type": "bounded_clip", "magnitude": -20.0, "unit": "kW", "direction": "decrease", "shape": "ramp", "ramp_seconds": 60}] if kind.startswith("phys") or kind == "cyber_physical" else []
        out.append({
            "scenario_id": f"zdl_other_case_{i:03d}", "scenario_family": "pv_curtailment_mismatch", "scenario_class": kind, "start_time_s": (i % 7) * 86_400 + 500 * i, "duration_s": 300, "affected_asset": "pv_001",
            "physical_effects": effects, "cyber_context": {"event_level_only": True, "packet_level_protocol_compliance_claimed": False, "cia_dimension": "integrity", "delivery_status": "delivered"},
            "labels": {"label_anomaly": int(kind != "normal"), "label_cyber_anomaly": 0, "label_physical_anomaly": 0},
        })
    return {"dataset_id": "d", "author_model": "other", "generation_purpose": bundles.PURPOSE, "compatibility_statement": bundles.COMPATIBILITY, "scenarios": out}


def documents(spark, *docs):
    return bundles.parsed(spark.createDataFrame([(f"b{i}", d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "bundle_id string, doc string"))


def faults(spark, *docs):
    out = {}
    for r in bundles.violations(documents(spark, *docs)).collect():
        out.setdefault(r.bundle_id, []).append((r.place, r.rule))
    return {k: sorted(v, key=str) for k, v in out.items()}


def changed(**fields):
    out = bundle()
    out.update(fields)
    return {k: v for k, v in out.items() if v is not ...}


def one(place, **fields):
    """A bundle of which one scenario has other fields; dotted names reach into its first effect, context or labels."""
    out = bundle()
    s = out["scenarios"][place]
    for name, value in fields.items():
        where, _, field = name.rpartition("__")
        inner = {"": s, "effect": (s["physical_effects"] or [None])[0], "context": s["cyber_context"], "labels": s["labels"]}[where]
        if value is ...:
            inner.pop(field)
        else:
            inner[field] = value
    return out


def test_bundles_are_repaired(spark):
    rows = bundles.scenarios(documents(spark, bundle(), one(15, scenario_class=..., cyber_physical_type="cyber_physical", target_component="bess", scenario_name="n", safety_note="s", effect__magnitude=7)))
    first = rows.filter("bundle_id = 'b0' and place = 15").first()
    assert first.target_asset_id == "pv_001" and first.target_component == "pv" and first.physical_effects[0].effect_type == "clip" and first.physical_effects[0].magnitude == 20.0
    assert first.repairs == ["alias_target_asset_id", "generated_scenario_name", "inferred_target_component", "default_safety_note", "effect_type_bounded_clip", "negative_magnitude"] and first.scenario_name == "zdl other case 015"
    second = rows.filter("bundle_id = 'b1' and place = 15").first()
    assert second.repairs == ["alias_scenario_class", "alias_target_asset_id", "effect_type_bounded_clip"] and (second.scenario_class, second.target_component, second.scenario_name) == ("cyber_physical", "bess", "n")
    whole = {r.bundle_id: r for r in bundles.judged(documents(spark, bundle())).collect()}["b0"]
    assert (whole.status, whole.errors, whole.warnings, whole.scenarios) == ("ACCEPTED", 0, 0, 16) and whole.repairs == 1 + 16 * 4 + 8 * 2
    # what is accepted reads as a bundle that needs no repair
    again = bundles.parsed(bundles.accepted(documents(spark, bundle(), "{")))
    assert [(r.status, r.repairs) for r in bundles.judged(again).collect()] == [("ACCEPTED", 0)]


def test_faults_of_scenarios(spark):
    cases = [
        (one(0, scenario_id="case 1"), [(0, "id_pattern")]), (one(0, scenario_id="zdl_grok_x_001"), [(0, "id_author")]), (one(0, scenario_id=7), [(0, "id_pattern"), (0, "type_scenario_id")]), (one(0, scenario_id=...), [(0, "id_pattern")]),
        (one(0, scenario_family="x"), [(0, "family")]), (one(0, affected_asset="pv35"), [(0, "forbidden_asset")]), (one(0, affected_asset="pv_9"), [(0, "asset")]), (one(0, target_component="x"), [(0, "component")]),
        (one(0, start_time_s=-5), [(0, "start_range")]), (one(0, start_time_s="12"), [(0, "start_range"), (0, "type_start_time_s")]), (one(0, duration_s=20), [(0, "duration_range")]), (one(0, duration_s=300.5), []), (one(0, start_time_s=604_700, duration_s=600), [(0, "end_range")]),
        (one(0, labels__label_anomaly=1), [(0, "normal_labels")]), (one(4, labels__label_anomaly=...), [(4, "missing_label_anomaly")]), (one(4, labels=[]), [(4, "missing_label_anomaly"), (4, "missing_label_cyber_anomaly"), (4, "missing_label_physical_anomaly"), (4, "type_labels")]),
        (one(4, physical_effects=[{"variable": "pv_p_kw", "magnitude": 1}]), [(4, "cyber_only_effects")]), (one(8, physical_effects=[]), [(8, "physical_without_effects")]), (one(8, physical_effects={}), [(8, "physical_without_effects"), (8, "type_physical_effects")]),
        (one(8, physical_effects=["x"]), [(8, "type_effect"), (8, "variable")]), (one(8, effect__variable="temperature_c"), [(8, "forbidden_variable")]), (one(8, effect__variable="x"), [(8, "variable")]), (one(8, effect__variable="irradiance_pu", effect__magnitude=1), [(8, "irradiance_family")]),
        (one(8, effect__magnitude=900), [(8, "magnitude_bounds")]), (one(8, context__event_level_only="true"), [(8, "event_level_only")]), (one(8, context__packet_level_protocol_compliance_claimed=True), [(8, "packet_claim")]),
        (one(8, cyber_context=...), [(8, "event_level_only"), (8, "packet_claim")]), (one(8, context__cia_dimension="some MALWARE"), [(8, "forbidden_word")]),
    ]
    found = faults(spark, *[doc for doc, _ in cases])
    for i, (_, want) in enumerate(cases):
        assert found.get(f"b{i}", []) == sorted(want, key=str), i


def test_faults_of_bundles(spark):
    twice = bundle()
    twice["scenarios"][1]["scenario_id"] = twice["scenarios"][2]["scenario_id"]
    short, crowded, strange = bundle(), bundle(), bundle()
    short["scenarios"].pop(0)
    for s in crowded["scenarios"][:5]:
        s["start_time_s"] = 100
    strange["scenarios"][0] = "normal"
    cases = [
        (None, ["invalid_json"]), (json.dumps(bundle())[:-5], ["invalid_json"]), ("[1]", ["type_bundle"]), (changed(dataset_id=..., author_model=...), ["missing_author_model", "missing_dataset_id"]), (changed(compatibility_statement=...), ["missing_project_compatibility_statement"]),
        (changed(scenarios={}), ["type_scenarios"]), (changed(scenarios=...), ["missing_scenarios"]), (changed(generation_purpose="x", compatibility_statement="y"), ["compatibility_statement", "generation_purpose"]),
        (changed(author_model="someone"), ["author_model"]), (twice, ["unique_id"]), (short, ["count_normal", "scenario_count"]), (crowded, ["day_1"]), (changed(scenarios=[]), ["count_cyber_only", "count_cyber_physical", "count_normal", "count_physical_only", "scenario_count"]), (strange, ["count_normal"]),
    ]
    found = faults(spark, *[doc for doc, _ in cases])
    for i, (_, want) in enumerate(cases):
        assert [rule for place, rule in found[f"b{i}"] if place is None] == want, i
    assert found["b13"] == [(0, "type_scenario"), (None, "count_normal")]
    assert bundles.violations(documents(spark).filter("false")).count() == 0


def test_counters(spark):
    rows = {(r.bundle_id, r.dimension, r.value): r.n for r in bundles.counters(bundles.scenarios(documents(spark, bundle(), one(8, affected_asset="bess_001", start_time_s=-1)))).collect()}
    assert rows["b0", "class", "normal"] == 4 and rows[None, "class", "normal"] == 8 and rows[None, "asset", "bess_001"] == 1 and rows[None, "variable", "pv_p_kw"] == 16
    assert sum(n for (b, d, _), n in rows.items() if b is None and d == "day") == 31 and (None, "day", "?") not in rows


def test_flags_and_packets(spark):
    df = spark.createDataFrame([("s1", "cyber_physical", "command_delay", "delayed", "integrity|availability", 1000, 400)], "scenario_id string, scenario_class string, scenario_family string, delivery string, cia string, start_time_s long, duration_s long")
    flags = scenarios.family_flags(F.col("scenario_family"), F.col("delivery"))
    status = scenarios.security_statuses(F.col("cia"), F.col("scenario_class"))
    row = df.select(*[c.alias(n) for n, c in (flags | status).items()], scenarios.cyber_state(F.col("scenario_class"), F.col("scenario_family"), F.lit("x")).alias("state"),
                    scenarios.delay_seconds(F.col("scenario_family"), F.array().cast("array<struct<ramp_seconds:bigint>>"), F.col("duration_s")).alias("delay")).first()
    assert (row.command_delay_active_flag, row.blocked_flag, row.integrity_status, row.availability_status, row.state, row.delay) == (1, 0, "compromised", "degraded", "delayed_command_context", 100)
    times = spark.createDataFrame([("s1", 1000, 1005, 1010, 1100, 990, True)], "scenario_id string, sent_s long, apply_s long, effect_start_s long, effect_end_s long, onset_s long, bad boolean")
    bounds = scenarios.context_bounds(times)
    assert (bounds.first().window_start_s, bounds.first().window_end_s) == (890, 1220)
    seconds = inside(spark.range(0, 3000).withColumnRenamed("id", "t"), "t", bounds, Interval("window_start_s", "window_end_s", True), 600)
    made = seconds.select("t", *[c.alias(n) for n, c in scenarios.context_flags(*[F.col(x) for x in ("t", "sent_s", "apply_s", "effect_start_s", "effect_end_s", "onset_s", "bad")]).items()])
    assert tuple(made.groupBy().sum("cyber_active_flag", "command_active_flag", "physical_effect_active_flag", "attack_active_flag").first()) == (121, 66, 91, 111)
    windows = spark.createDataFrame([("s1", *[v for _ in range(4) for v in (1.0, 2.0, 1.0)]), ("s1", *[v for _ in range(4) for v in (3.0, 120.0, 0.01)])],
                                    "scenario_id string, " + ", ".join(f"{k}_{s} double" for s in ("p_kw", "q_kvar", "voltage_pu", "soc_percent") for k in ("baseline", "actual", "residual")))
    checks, evidence = scenarios.constraint_checks(windows), scenarios.physical_evidence(windows)
    assert [c.status for c in checks.first().checks] == ["fail", "fail", "fail", "warning"]
    packet = json.loads(scenarios.packets(df, checks, evidence).first().packet)
    assert packet["physical_evidence"][0] == {"field": "p_kw", "baseline": 2.0, "actual": 61.0, "residual": 0.505} and packet["timing"] == "active from 1000 s to 1399 s"
