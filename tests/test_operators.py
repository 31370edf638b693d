"""Operators on small tables with known answers."""

from __future__ import annotations

import hashlib
import json
import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewell.functions import scalar, timeaxis
from tidewell.operators import calls, detectors, effects, explain, intervals, lifecycle, metrics, quality, registry, windows
from tidewell.operators.intervals import Interval
from tidewell.sources import readers, sinks
from tidewell.streaming import hopping


def test_windows_count_and_statistics(spark):
    n, width, stride = 600, 60, 10
    x = np.sin(np.arange(n) / 7) * 3 + np.arange(n) % 5
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t long, v double")
    rows = {r.window_id: r for r in windows.window_features(df, "t", ["v"], width, stride, "t").collect()}
    assert len(rows) == (n - width) // stride + 1
    for k in (0, 17, 54):
        part = x[k * stride : k * stride + width]
        slope = np.polyfit(np.arange(width), part, 1)[0]
        got = rows[k]
        assert got.n == width
        expected = (part.mean(), part.std(), part.min(), part.max(), np.median(part), slope, part[0], part[-1], part[-1] - part[0], np.sqrt((part**2).mean()))
        assert np.allclose([got[s] for s in windows.STATISTICS], expected)


def test_a_week_has_the_known_number_of_windows(spark):
    df = spark.range(604_800).withColumnRenamed("id", "t").filter("t >= 604000")
    last = windows.hopping(df, "t", 60, 10, 604_800).agg(F.max("window_id")).first()[0]
    assert last + 1 == 60_475


def test_dominant_prefers_the_first_seen(spark):
    df = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, ""), (1, 5, None), (2, 0, None)], "g int, i int, v string")
    assert [(r.g, r.dominant, r.votes) for r in windows.dominant(df, ["g"], "v", "i").collect()] == [(1, "b", 2)]


def test_charge_level_clamps_each_step(spark):
    power = [-50.0, -50.0, 80.0, 10.0, -1000.0]
    df = spark.createDataFrame([("x", i, p) for i, p in enumerate(power)], "k string, i int, p double")
    level = 50.0
    for p in power:
        energy = -p * 0.9 if p < 0 else -p / 0.8
        level = min(90.0, max(10.0, level + 100 * (energy - 0.1) / 200))
    got = windows.charge_level(df, ["k"], ["i"], F.col("p"), 200.0, 50.0, 10.0, 90.0, 0.9, 0.8, 0.1, 1.0).first()
    assert got.level == pytest.approx(level)


def test_intervals(spark):
    spans = spark.createDataFrame([("a", 10, 30, 0, 1), ("b", 25, 40, 1, 0), ("c", 100, 100, 2, 1)], "id string, s long, e long, o int, bad int")
    labels = {r.time_s: r for r in intervals.overlap_labels(spans, Interval("s", "e", True), "id", "o", ["bad"]).collect()}
    assert len(labels) == 32 and labels[27].scenario_id == "MULTIPLE" and labels[27].active_ids == "a|b" and labels[27].first_id == "a" and labels[27].bad == 1
    assert labels[100].scenario_id == "c" and labels[35].bad == 0
    half = intervals.overlap_labels(spans, Interval("s", "e"), "id", "o", ["bad"])
    assert half.count() == 30 and half.filter("time_s = 100").count() == 0
    aligned = intervals.align(spark.range(0, 200).withColumnRenamed("id", "time_s"), half)
    assert {r.alignment_status: r["count"] for r in aligned.groupBy("alignment_status").count().collect()} == {"BACKGROUND": 170, "SCENARIO_ACTIVE": 25, "OVERLAP_MULTIPLE": 5}
    points = spark.range(0, 200).withColumnRenamed("id", "t")
    met = intervals.inside(points, "t", spans.select("id", "s", "e"), Interval("s", "e", True), 7)
    assert {r.id: r["count"] for r in met.groupBy("id").count().collect()} == {"a": 21, "b": 16, "c": 1}
    assert [r.id for r in intervals.non_overlapping(spans, Interval("s", "e", True), "id").orderBy("s").collect()] == ["a", "c"]


def test_lifecycles(spark):
    kinds = spark.createDataFrame([(i, k, 100) for i, k in enumerate(lifecycle.STAGES)], "id int, kind string, t long")
    rows = lifecycle.expand(kinds, "kind", "t", [1, 2, 1, 5, 3])
    assert rows.count() == sum(map(len, lifecycle.STAGES.values()))
    times = lifecycle.stage_times(rows, "id", "lifecycle_stage", "stage_time_s", ["DER_CONTROL_CREATED", "DER_CONTROL_APPLIED", "SECURITY_BLOCKED_COMMAND"]).orderBy("id").collect()
    assert tuple(times[0])[1:] == (100, 109, None) and tuple(times[1])[1:] == (100, None, 104)
    days = spark.createDataFrame([(0,), (1,)], "d long")
    counts = {r.routine: r["count"] for r in lifecycle.routines(days, "d").groupBy("routine").count().collect()}
    assert counts == {"command": 16, "storage": 4, "metering": 192, "status": 48}
    assert [r.time_s for r in lifecycle.routines(days, "d", {"x": [3600, 7200]}).orderBy("time_s").collect()] == [3600, 7200, 90000, 93600]
    reading = lifecycle.meter_readings(spark.createDataFrame([("pcc_001", 100, 5.0, 1.0)], "a string, t long, p double, q double"), "a", "t", "p", "q", {"label_anomaly": F.lit(1)}).first()
    assert (reading.command_accept_time_ms, reading.label_anomaly, reading.total_delay_s, reading.applied_q_kvar, len(reading.message_mrid)) == (100_070, 1, 0.045, 1.0, 36)


EFFECTS = "variable string, effect_order int, type string, magnitude double, unit string, direction string, shape string, ramp_s int, start_s long, end_s long"


def fold(signals, rows, bounds):
    """Effects one after the other on whole windows, as arrays."""
    out = {v: sorted((t, x) for t, w, x in signals if w == v) for v in {s[1] for s in signals}}
    for variable, _, kind, magnitude, unit, direction, shape, ramp, start, end in sorted(rows, key=lambda r: (r[0], r[1])):
        series = out.get(variable, [])
        at = [i for i, (t, _) in enumerate(series) if start <= t < end]
        old = [series[i][1] for i in at]
        times = [series[i][0] for i in at]
        low, high = bounds.get(variable, (-math.inf, math.inf))
        kind, size, sign = effects.ALIASES.get(kind, kind), abs(magnitude), 1 if direction == "increase" else -1
        for k, i in enumerate(at):
            t, v = series[i]
            f = min(1, max(0, (t - start) / ramp)) if shape == "ramp" and ramp > 0 else 1
            if kind == "absolute_delta":
                v += sign * size * f
            elif kind == "relative_delta":
                v *= 1 + sign * (size / 100 if unit == "%" else size) * f
            elif kind == "hold_stale":
                v = old[0]
            elif kind == "clip":
                v = min(v, size)
            elif kind == "smooth_oscillation":
                v += size * math.sin(2 * math.pi * (t - start) / min(120, max(30, end - start)))
            elif kind == "delay_response":
                v = max([(u, j) for j, u in enumerate(times) if u <= t - ramp], default=(0, k))[1]
                v = old[v]
            series[i] = (t, min(high, max(low, v)))
    return {(v, t): x for v, s in out.items() for t, x in s}


def test_effects_of_each_kind(spark):
    signals = [(t, "load", 10.0) for t in range(60)]
    cases = [
        (("relative_delta", 50.0, "%", "decrease", "step", 0), 15, 5.0), (("relative_delta", 0.5, "pu", "increase", "step", 0), 15, 15.0), (("relative_delta", 50.0, "%", "bidirectional", "step", 0), 15, 5.0),
        (("absolute_delta", -4.0, "kW", "increase", "step", 0), 15, 14.0), (("absolute_delta", 4.0, "kW", "none", "ramp", 30), 15, 8.0), (("smooth_oscillation", 5.0, "kW", "bidirectional", "step", 0), 15, 15.0),
        (("bounded_clip", -3.0, "kW", "none", "step", 0), 15, 3.0), (("delay_response", 3.0, "kW", "increase", "delay", 20), 30, 10.0), (("none", 3.0, "kW", "increase", "step", 0), 15, 10.0),
    ]
    frame = spark.createDataFrame(signals, "time_s long, variable string, value double")
    for (kind, size, unit, direction, shape, ramp), t, want in cases:
        fx = spark.createDataFrame([("load", 0, kind, size, unit, direction, shape, ramp, 0, 60)], EFFECTS)
        got = {r.time_s: r.changed for r in effects.apply_effects(frame, fx, 7).collect()}
        assert got[t] == pytest.approx(want), kind
    # a hold keeps what the delta before it left
    both = spark.createDataFrame([("load", 0, "absolute_delta", 5.0, "kW", "decrease", "step", 0, 0, 60), ("load", 1, "hold_stale", 0.0, "%", "none", "hold", 0, 10, 30)], EFFECTS)
    assert {r.changed for r in effects.apply_effects(frame, both).collect()} == {5.0}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_effects_equal_arrays(spark, seed):
    rng = random.Random(seed)
    kinds = ["absolute_delta", "relative_delta", "hold_stale", "stale_value_hold", "clip", "smooth_oscillation", "delay_response", "unknown"]
    signals = [(t, v, round(rng.uniform(-60, 130), 2)) for v in ("pv_p_kw", "bess_p_kw", "free") for t in range(0, 400) if rng.random() < 0.7]
    rows = []
    for k in range(40):
        start = rng.randrange(-20, 390)
        rows.append((rng.choice(["pv_p_kw", "bess_p_kw", "free", "gone"]), k, rng.choice(kinds), rng.choice([0.0, 20.0, -35.0, 80.0]), rng.choice(["%", "kW", "none"]), rng.choice(["increase", "decrease", "none", "bidirectional"]), rng.choice(["ramp", "step", "hold"]), rng.choice([0, 5, 40]), start, start + rng.randrange(0, 90)))
    frame = spark.createDataFrame(signals, "time_s long, variable string, value double")
    got = {(r.variable, r.time_s): r for r in effects.apply_effects(frame, spark.createDataFrame(rows, EFFECTS), 50).collect()}
    want = fold(signals, rows, effects.BOUNDS)
    assert set(got) == set(want)
    for key, value in want.items():
        assert got[key].changed == pytest.approx(value), key
        assert got[key].effects == sum(r[0] == key[0] and r[8] <= key[1] < r[9] for r in rows)


def test_effects_with_orders_of_structs_nulls_and_no_rows(spark):
    signals = spark.createDataFrame([(0, "a", 1.0), (1, "a", None), (2, "a", 3.0)], "time_s long, variable string, value double")
    fx = spark.createDataFrame([("a", 0, "hold_stale", 0.0, "", "none", "hold", 0, 1, 3), ("a", 1, "absolute_delta", 1.0, "", "increase", "step", 0, 0, 3)], EFFECTS)
    nested = fx.withColumn("effect_order", F.struct(F.lit("bundle").alias("b"), F.col("effect_order").alias("place")))
    assert [r.changed for r in effects.apply_effects(signals, nested).orderBy("time_s").collect()] == [2.0, None, None]
    assert [r.changed for r in effects.apply_effects(signals, fx.limit(0)).orderBy("time_s").collect()] == [1.0, None, 3.0]
    assert effects.apply_effects(signals.limit(0), fx).count() == 0


@pytest.mark.parametrize("bucket", [1, 10, 1000])
def test_as_of(spark, bucket):
    rng = random.Random(bucket)
    history = [(rng.choice(["a", "b", None]), rng.randrange(0, 300), rng.random()) for _ in range(80)]
    points = [(rng.choice(["a", "b", "c", None]), rng.randrange(-10, 320), i) for i in range(120)]
    got = intervals.as_of(spark.createDataFrame(points, "k string, t long, i int"), spark.createDataFrame(history, "k string, t long, v double"), "t", ["v"], ["k"], bucket).collect()
    assert len(got) == len(points)
    for r in got:
        assert r.v == max(((t, v) for k, t, v in history if k == r.k and t <= r.t), default=(0, None))[1]


def test_metrics_with_ties_and_one_class(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.9), ("a", 1, 0.5), ("a", 0, 0.1), ("a", 0, float("nan")), ("b", 1, 0.3), ("b", 1, 0.4)]
    df = spark.createDataFrame(rows, "g string, y int, score double")
    auc = {r.g: r.roc_auc for r in metrics.roc_auc(df, ["g"]).collect()}
    assert auc["a"] == pytest.approx((0.5 + 1 + 0 + 1) / 4) and auc["b"] is None
    ap = {r.g: r.average_precision for r in metrics.average_precision(df, ["g"]).collect()}
    assert ap["a"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3, abs=1e-6) and ap["b"] == 1.0
    best = metrics.choose_threshold(df.filter("g = 'a' and not isnan(score)"), [50, 90]).first()
    assert best.percent == 50.0
    fallback = metrics.choose_threshold(df.filter("g = 'a' and not isnan(score)").withColumn("y", F.lit(0)), [50, 90]).first()
    assert fallback.percent == 95.0
    empty = metrics.evaluate(df.filter("g = 'b'"), ["g"], F.col("y") == 1, F.col("score") > 1).first()
    assert (empty.precision, empty.recall, empty.f1) == (0.0, 0.0, 0.0)


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=700), np.full(300, 0.25), [1e6]])
    df = spark.createDataFrame([(float(v), 7.0, None) for v in x] + [(float("nan"), None, None)], "a double, b double, c double")
    percents = [0, 1, 37.5, 50, 90, 99.9, 100]
    got = metrics.exact_percentiles(df, ["a", "b", "c"], percents, bins=16)
    assert np.allclose(got["a"], np.percentile(x, percents)) and got["b"] == [7.0] * 7 and got["c"] == [None] * 7


def test_audit_and_rollup(spark):
    a = spark.createDataFrame([("m", 0.5, 1.0), ("n", 0.2, 1.0)], "k string, f1 double, auc double")
    b = spark.createDataFrame([("m", 0.50001, 0.9), ("o", 0.2, 1.0)], "k string, f1 double, auc double")
    got = {(r.k, r.metric): r.status for r in metrics.recompute_audit(a, b, "k", ["f1", "auc"]).collect()}
    assert got["m", "f1"] == "PASS" and got["m", "auc"] == "FAIL" and got["n", "f1"] == got["o", "auc"] == "MISSING"
    df = spark.createDataFrame([(1, "a"), (1, None), (3, "z")], "k int, v string")
    checks = quality.run_checks(df, [quality.row_count(3), quality.no_duplicates("k"), quality.no_nulls("v"), quality.in_range("k", 0, 2, "WARN")])
    assert {r.check_name: (r.violations, r.status) for r in checks.collect()} == {"row_count": (0, "PASS"), "unique_k": (1, "FAIL"), "not_null_v": (1, "FAIL"), "range_k": (1, "WARN")}
    assert quality.rollup(checks).first().overall == "FAIL"
    assert quality.missing_columns(df, ["k", "x"]) == ["x"] and quality.first_present(df, ["x", "v"]) == "v"
    names = quality.denied_names(spark.createDataFrame([("label_mean",), ("pv_std",)], "feature string"), ["label"])
    assert [r.feature for r in names.collect()] == ["label_mean"]


def test_detectors_find_the_outlier(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(300)] + [(999, 9.0, -9.0, 9.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    features = ["a", "b", "c"]
    robust = detectors.robust_z(df, detectors.robust_parameters(df, features))
    forest = detectors.fit_isolation_forest(df, features, "id", trees=30)
    isolated = detectors.score_rows(df, features, forest.score)
    mean, parts = detectors.pca_basis(df.filter("id < 999"), features, 0.6)
    wrong = detectors.pca_error(df, features, (mean, parts[:1]))
    for scored in (robust, isolated, wrong):
        assert scored.orderBy(F.desc("score")).first().id == 999
    x = np.array([r[1:] for r in rows[:300]])
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert abs(abs(vectors[:, -1] @ parts[0]) - 1) < 1e-9
    assert detectors.not_run(df, "m", "why").first().status == "NOT_RUN"


def test_calls_are_made_once_and_repaired_by_the_parse(spark, tmp_path):
    ledger, log = str(tmp_path / "ledger"), tmp_path / "log"
    log.mkdir()

    def client(prompt):
        (log / f"{hashlib.sha256(prompt.encode()).hexdigest()}-{uuid.uuid4().hex}").touch()
        name, _, again = prompt.partition("\n")
        if name == "down" or (name == "breaks" and again):
            raise OSError("down")
        return {"good": '```json\n{"explanation_type": "normal", "evidence_used": "x"}\n```', "list": "[1]", "": "{}"}.get(name, '{"explanation_type": "cyber_only"}' if again else '{"broken": ')

    rows = [("good", 1), ("good", 2), ("down", 3), ("breaks", 4), ("mends", 5), ("list", 6), (None, 7)]
    prompts = spark.createDataFrame(rows, "prompt string, answer int")
    got = {r.prompt: r for r in calls.explanations(prompts, client, ledger=ledger, model="m").collect()}
    assert {k: r.parse_status for k, r in got.items()} == {"good": "OK", "down": "FAILED_CALL_ERROR", "breaks": "FAILED_REPAIR_CALL_ERROR", "mends": "OK_REPAIRED", "list": "FAILED", None: "OK"}
    assert got["good"].parsed.evidence_used == ["x"] and got["good"].parsed.confidence == "low" and got[None].parsed.explanation_type == "insufficient_evidence"
    assert got["mends"].parsed.explanation_type == "cyber_only" and got["down"].error == "OSError: down" and got["breaks"].parsed is None
    made = len(list(log.iterdir()))
    assert made == 6 + 3
    # what is in the ledger is not called again, but for what had failed; another model's answers are others
    again = calls.explanations(prompts.unionByName(spark.createDataFrame([("new", 8)], "prompt string, answer int")), client, ledger=ledger, model="m")
    assert sorted(r.parse_status for r in again.collect()) == sorted([*("OK",) * 3, "FAILED_CALL_ERROR", "FAILED_REPAIR_CALL_ERROR", "OK_REPAIRED", "OK_REPAIRED", "FAILED"])
    assert len(list(log.iterdir())) == made + 1 + 1 + 2
    assert {r.parse_status for r in calls.explanations(prompts, None).collect()} == {"SKIPPED_LLM_NOT_READY"}
    assert calls.explanations(prompts.limit(0), client, ledger=str(tmp_path / "none")).count() == 0


def test_penalties_and_parsing(spark):
    prompts = spark.createDataFrame([("p1",)], "prompt string")
    flags = prompts.limit(1).select(*[c.alias(n) for n, c in explain.penalties(F.lit("In this timeframe the proof is that exploitation was registered")).items()]).first()
    assert (flags.packet_claim_flag, flags.uses_old_asset_name_flag, flags.external_attacker_claim_flag) == (0, 0, 0)
    said = explain.penalties(F.lower(F.lit("In this timeframe the PACKETS of bess48")), {"unsupported_claim_flag": F.lit(True)})
    assert [prompts.limit(1).select(said[n]).first()[0] for n in ("packet_claim_flag", "uses_old_asset_name_flag", "unsupported_claim_flag", "field_telemetry_claim_flag")] == [1, 1, 1, 0]
    broken = spark.createDataFrame([("{bad json}",), ('{"verdict": "x"}',), ("",)], "answer string")
    assert [r.parse_success for r in explain.parsed(broken, "verdict string").collect()] == [False, True, False]
    assert prompts.limit(1).select(explain.filled("a {{x}} b", {"x": F.lit(3)}).alias("t")).first().t == "a 3 b"


def test_evidence(spark):
    telemetry = spark.createDataFrame([(t, float(t), 5.0, float(-t % 7)) for t in range(100)], "time_s long, up double, flat double, saw double")
    hits = spark.createDataFrame([("d1", "s1", 10, 20), ("d2", "s9", 90, 99)], "detection_id string, scenario_id string, window_start_s long, window_end_s long")
    rows = explain.signal_evidence(hits, telemetry, ["up", "flat", "saw"], 30, top=2).orderBy("detection_id", "rank").collect()
    assert [(r.detection_id, r.signal, r.direction, r.points) for r in rows] == [("d1", "up", "increase", 11), ("d1", "saw", "increase" if rows[1].delta > 0 else "decrease", 11), ("d2", "up", "increase", 10), ("d2", "saw", rows[3].direction, 10)]
    scenarios = spark.createDataFrame([("s1", 15, 60)], "scenario_id string, start_time_s long, end_time_s long")
    status = {r.detection_id: (r.shared_s, r.timing_status) for r in explain.timing(hits, scenarios, "scenario_id").collect()}
    assert status == {"d1": (6, "overlapping"), "d2": (None, "timing_unknown")} or status["d1"] == (6, "overlapping")
    wide = explain.series(telemetry.filter("time_s < 3"), [], "time_s", ["up"])
    assert wide.first()["up"] == [0.0, 1.0, 2.0]


def test_time_axis(spark):
    df = spark.createDataFrame([("2024-01-02T00:00:05Z",), ("2024-01-01T00:00:01.500Z",), ("2024-01-01T00:00:00+00:00Z",), ("",), (None,)], "s string")
    assert [r.x for r in df.select(timeaxis.parse_seconds(F.col("s"), "2024-01-01 00:00:00").alias("x")).collect()] == [86405, 1, -1, -1, -1]
    spine = timeaxis.spine(spark, 3, 1, "2024-01-01 00:00:00").orderBy("time_s").collect()
    assert [r.timestamp_utc for r in spine] == [f"2024-01-01T00:00:0{i}Z" for i in range(3)]


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, '["a","b"]'), (float("nan"), "lone"), (float("inf"), None)], "x double, l string")
    assert [r.f for r in df.select(scalar.finite(F.col("x"), 2).alias("f")).collect()] == [1.0, None, None]
    assert [r.t for r in df.select(scalar.text_list(F.col("l")).alias("t")).collect()] == [["a", "b"], ["lone"], []]
    phases = scalar.imbalance([F.lit(1.0), F.lit(1.0), F.lit(0.94)])
    row = df.limit(1).select(phases[1].alias("u"), phases[2].alias("s")).first()
    assert row.u == pytest.approx(0.04) and row.s == "TRIP"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a, b ,c\n1, x ,2.5\nno,y,\n")
    df = readers.csv(spark, str(tmp_path / "in.csv"), "a string, b string, c double", padded=True)
    assert [r.b for r in df.collect()] == ["x", "y"]
    assert [r.n for r in df.select(readers.numeric("a", -1.0, "double").alias("n")).collect()] == [1.0, -1.0]
    assert readers.pick(df, ["c", "zz", "a"]).columns == ["c", "a"]
    assert readers.first_available(df, ["zz", "b"], "name").first().name == "x"
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "one.json").write_text('{"id": 1,\n "items": [{"k": 1}, {"k": 2}]}')
    (tmp_path / "docs" / "sub" / "two.json").write_text('{"id": 2, "items": []}')
    found = readers.json_documents(spark, str(tmp_path / "docs"))
    assert sorted((r.id, len(r.items)) for r in found.collect()) == [(1, 2), (2, 0)]
    (tmp_path / "rows.jsonl").write_text('{"k": 1, "v": "old"}\n{"k": 2, "v": "x"}\n{"k": 1, "v": "new"}\n')
    assert sorted((r.k, r.v) for r in readers.json_lines(spark, str(tmp_path / "rows.jsonl"), "k").collect()) == [(1, "new"), (2, "x")]
    marks = readers.fingerprints(spark, str(tmp_path / "docs")).collect()
    assert len(marks) == 2 and all(len(r.digest) == 64 for r in marks)
    assert readers.files(spark, str(tmp_path / "docs"), [".json"], ["sub"]).count() == 1
    lines = ["! comment", "New PVSystem.PV1 bus1=634 kVA=500 ! note", "~ pf=0.98 kv=[4.16 0.48]", "Set mode=daily", "New Storage.B1 kWh=200", "More kW=50"]
    table = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "source_path string, line int, value string")
    objects = {(r.object, r.key): r.value for r in readers.network_objects(table).collect()}
    assert objects == {("PVSystem.PV1", "bus1"): "634", ("PVSystem.PV1", "kva"): "500", ("PVSystem.PV1", "pf"): "0.98", ("PVSystem.PV1", "kv"): "[4.16 0.48]", ("Storage.B1", "kwh"): "200", ("Storage.B1", "kw"): "50"}
    large = {r.path.rsplit("/", 1)[1]: (r.digest is None, r.status) for r in readers.fingerprints(spark, str(tmp_path / "docs"), most=30).collect()}
    assert large == {"one.json": (True, "TOO_LARGE"), "two.json": (False, "OK")}
    out = str(tmp_path / "table")
    sinks.append_aligned(df.select("a"), out)
    sinks.append_aligned(df.select("a", "c"), out)
    assert sorted(sinks.read_aligned(spark, out).columns) == ["a", "c"] and sinks.read_aligned(spark, out).count() == 4
    assert sinks.xml_text(df.limit(1), "<p>{b}</p>", b=F.lit("<&>")).first().value == "<p>&lt;&amp;&gt;</p>"
    assert "| x |" in sinks.markdown(df.select("b"))
    (tmp_path / "x.xml").write_text("<all><row><k>1</k></row><row><k>2</k></row></all>")
    assert readers.xml_documents(spark, str(tmp_path / "x.xml"), "row", "k int").count() == 2


def test_stream_of_events(spark, tmp_path):
    base = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 01:10:00", "a", 2.0), ("2024-01-01 05:00:00", "b", 5.0)], "ts string, k string, v double")
    base.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "in"))
    query = hopping.hopping_counts(stream, "ts", ["k"], "v").writeStream.outputMode("append").format("memory").queryName("hops").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    rows = spark.sql("select * from hops where k = 'a' order by window_start").collect()
    assert [(r.n, r.total) for r in rows] == [(1, 1.0), (2, 3.0), (1, 2.0)]


def test_percentiles_of_groups(spark, monkeypatch):
    monkeypatch.setattr(metrics, "REST", 50)
    rng = np.random.default_rng(8)
    groups = {"a": [*rng.normal(0, 1, 3000), 1e300], "b": [5.0] * 40, None: [float("inf"), 1.0, 2.0], "d": [1e308, -1e308, 0.0, 3.0, 3.0]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("e", None), ("b", float("nan"))], "g string, v double")
    percents = [0, 10, 50, 99]
    got = {r.g: r.percentiles for r in metrics.percentiles_by(df, ["g"], "v", percents, bins=8).collect()}
    assert set(got) == set(groups)
    for k in ("a", "b", "d"):
        assert np.allclose(got[k], np.percentile(groups[k], percents))
    assert got[None][:3] == [1.0, 1.2, 2.0]


def test_curves_over_bins(spark):
    rng = np.random.default_rng(9)
    rows = [(g, float(s), int(y)) for g in ("a", None) for s, y in zip([*rng.integers(0, 90, 400), 1e12], rng.integers(0, 2, 401), strict=True)]
    df = spark.createDataFrame(rows, "g string, score double, y int")
    points = {(r.g, r.score): (r.tp, r.fp) for r in metrics.curve(df, ["g"]).collect()}
    auc = {r.g: r.roc_auc for r in metrics.roc_auc(df, ["g"]).collect()}
    for g in ("a", None):
        own = [r for r in rows if r[0] == g]
        for s in {r[1] for r in own}:
            assert points[g, s] == (sum(r[2] for r in own if r[1] >= s), sum(1 - r[2] for r in own if r[1] >= s))
        pos, neg = [r[1] for r in own if r[2]], [r[1] for r in own if not r[2]]
        wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert abs(auc[g] - wins / len(pos) / len(neg)) < 1e-6


def test_placements_over_buckets(spark):
    rng = np.random.default_rng(10)
    rows = [(i, int(s), int(s + d)) for i, (s, d) in enumerate(zip(rng.integers(0, 20_000, 300), rng.integers(1, 400, 300), strict=True))]
    df = spark.createDataFrame(rows, "id int, s long, e long")
    got = {r.id for r in intervals.non_overlapping(df, Interval("s", "e", True), "id", bucket=100).collect()}
    latest, want = None, set()
    for i, s, e in sorted(rows, key=lambda r: (r[1], r[0])):
        if latest is None or latest < s:
            want.add(i)
        latest = e if latest is None else max(latest, e)
    assert got == want


@pytest.mark.parametrize("bucket", [1, 7, 5000])
def test_covering_counts(spark, bucket):
    rng = random.Random(bucket)
    spans = [(a := rng.randrange(0, 200), a + rng.randrange(-2, 60)) for _ in range(60)]
    points = [(rng.randrange(-20, 280), i) for i in range(150)] + [(None, 999)]
    frame, held = spark.createDataFrame(points, "t long, i int"), spark.createDataFrame(spans, "s long, e long")
    for closed in (False, True):
        got = {r.i: r.covering for r in intervals.covering(frame, "t", held, Interval("s", "e", closed), bucket).collect()}
        assert got == {i: sum(t is not None and s <= t and (t <= e if closed else t < e) for s, e in spans) for t, i in points}
    assert [r.covering for r in intervals.covering(frame.limit(2), "t", held.limit(0), Interval("s", "e")).collect()] == [0, 0]


def test_placements_do_not_overlap(spark):
    requests = spark.createDataFrame([(i, 100 + i % 7, "x") for i in range(120)] + [(500, 10**9, "long"), (501, None, "null"), (502, 0, "none")], "id long, n long, start_s_old string")
    made = [intervals.placed(requests.repartition(k), "id", "n", 40_000, 600, 30, 900).collect() for k in (1, 5)]
    at = [{r.id: r.start_s for r in rows} for rows in made]
    assert at[0] == at[1] and [at[0][k] for k in (500, 501, 502)] == [None] * 3
    spans = sorted((s, s + 100 + i % 7) for i, s in at[0].items() if s is not None)
    assert len(spans) == 120 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[0][0] >= 600 and spans[-1][1] <= 40_000 - 600
    # an axis without room for all keeps what fits, still without overlaps
    few = [r.start_s for r in intervals.placed(requests, "id", "n", 4000, 600, 12).collect() if r.start_s is not None]
    assert 5 < len(few) < 27


@pytest.mark.parametrize("n", [1, 255, 257, 60_000])
def test_levels_of_long_buckets(spark, n):
    """One bucket with very many rows, and many buckets with one each, as a plain loop."""
    steps = [((i * 37) % 11 - 5.2) for i in range(n)]
    rows = spark.range(n).withColumn("s", (F.col("id") * 37) % 11 - 5.2).withColumn("k", F.lit("a"))
    want, x = [], 3.0
    for s in steps:
        x = min(20.0, max(0.0, x + s))
        want.append(x)
    for bucket in (F.lit(0), F.col("id")):
        if n > 1000 and str(bucket) == str(F.col("id")):
            continue
        made = windows.level_series(rows, ["k"], ["id"], bucket, windows.clamp(F.col("s"), 0, 20), windows.clamps(), 3.0).orderBy("id").collect()
        assert [r.level for r in made] == pytest.approx(want)


def test_registry_equals_numpy(spark):
    """Every kind of model, fitted as tasks and kept as rows, against the same by plain arrays; thresholds are those of the fit."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) * [1, 5, 0.1, 20] + [0, 2, 5, -9]
    x[380:] += 8 * x.std(0)
    rows = [(i, *map(float, r), int(i >= 380)) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, (999, None, 1.0, 5.0, -9.0, 0)], "id int, a double, b double, c double, d double, y int")
    features = ["a", "b", "c", "d"]
    train = df.filter("y = 0 and id < 999")
    grid = (("30_0.05", 30, 0.05), ("60_0.10", 60, 0.10))
    models = registry.z_models(train, features).unionByName(registry.pca_models(train, features, (("variance_0.90", 0.9), ("components_2", 2), ("components_4", 4))))
    models = models.unionByName(registry.forest_models(train, features, "id", grid)).unionByName(registry.not_run(spark, "svm", "why"))
    path = sinks.scratch(spark, "registry")
    models.write.parquet(path)
    models = spark.read.parquet(path)
    held = {(r.model_name, r.config): r for r in models.select("model_name", "config", "failure_reason", F.to_json("parameters").alias("p")).collect()}
    assert held["pca", "components_4"].failure_reason and held["svm", "primary"].p is None and len(json.loads(held["isolation_forest", "60_0.10"].p)["trees"]) == 60
    got = {(r.id, r.model_name, r.config): r.score for r in registry.scores(df, models, ["id"]).collect()}
    assert len(got) == 401 * 7
    fit = x[:380]
    z = (x - fit.mean(0)) / (fit.std(0) + 1e-8)
    assert [got[i, "standard_z", "primary"] for i in range(400)] == pytest.approx(np.abs(z).max(1))
    assert [got[i, "distance", "primary"] for i in range(400)] == pytest.approx(np.sqrt((z**2).sum(1)), rel=1e-6)
    median = np.median(fit, 0)
    assert [got[i, "robust_z", "primary"] for i in range(400)] == pytest.approx((np.abs(x - median) / (1.4826 * np.median(np.abs(fit - median), 0) + 1e-8)).max(1))
    values, vectors = np.linalg.eigh(np.cov(z[:380].T, bias=True))
    two = vectors[:, np.argsort(values)[::-1][:2]]
    c = z - z[:380].mean(0)
    assert [got[i, "pca", "components_2"] for i in range(400)] == pytest.approx(((c - c @ two @ two.T) ** 2).mean(1))
    for name, _, share in grid:
        p = json.loads(held["isolation_forest", name].p)
        depth = np.zeros(400)
        for tree in p["trees"]:
            for i in range(400):
                at = 0
                while tree["f"][at] >= 0:
                    at = tree["left"][at] + int(z[i, tree["f"][at]] >= tree["cut"][at])
                depth[i] += tree["cut"][at]
        usual = 2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256
        raw = 2 ** (-depth / len(p["trees"]) / usual)
        assert [got[i, "isolation_forest", name] + p["shift"] for i in range(400)] == pytest.approx(raw)
        assert p["shift"] == pytest.approx(np.percentile(raw[:380], 100 * (1 - share)))
    cuts = registry.thresholds(registry.scores(df, models, ["y"]))
    best = {(r.model_name, r.config): r for r in cuts.collect()}
    assert all(r.f1 > 0.9 for r in best.values() if r.model_name != "pca") and sum(r.selected for r in best.values()) == 5
    chosen = registry.frozen(models, cuts, sinks.scratch(spark, "frozen"))
    few = {(r.id, r.model_name): r for r in registry.judge(df.filter("id < 3"), chosen, "id").collect()}
    assert few[None, "svm"].failure_reason == "why" and len(few) == 3 * 5 + 1
    cut = {r.model_name: r.threshold for r in chosen.filter("threshold is not null").collect()}
    assert all(r.y_pred == int(r.score >= cut[m] - 1e-6) for (i, m), r in few.items() if i is not None)
    stacked = registry.stacked_model(registry.scores(df.filter("id < 999"), chosen, ["id", "y"]), "id", "y")
    both = {(r.id, r.model_name): r.score for r in registry.scores(df, chosen.drop("threshold").unionByName(stacked), ["id"]).collect()}
    assert min(both[i, "stacked"] for i in range(380, 400)) > max(both[i, "stacked"] for i in range(0, 380))
    assert registry.forest_models(train.limit(0), features, "id", grid).filter("failure_reason is null").count() == 0


def test_percentiles_of_groups_do_not_bring_a_group_to_a_task(spark, monkeypatch):
    """Of what two passes shuffle, no task reads more than bins: the rows stay where they are read."""
    monkeypatch.setattr(metrics, "REST", 50)
    frame, plans = type(spark.range(0)), []
    collect = frame.collect

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return collect(df)

    monkeypatch.setattr(frame, "collect", seen)
    rows = spark.range(20_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    got = metrics.percentiles_by(rows, ["g"], "v", [50], bins=16)
    joins = [p for p in plans if "Join Inner" in p]
    assert joins and all("strategy=broadcast" in p for p in joins)
    assert sorted((r.g, r.percentiles[0]) for r in got.toLocalIterator()) == [(k, float(np.percentile([i * 7919 % 20_011 for i in range(k, 20_000, 2)], 50))) for k in (0, 1)]


def test_text_files_are_written_by_several_tasks(spark, tmp_path):
    """Files are few bytes and many; adaptive execution would leave them to one task. Names and lines are those of Spark's writer."""
    rows = spark.createDataFrame([(i % 3, f"n{i}", f"t{i}") for i in range(60)] + [(1, "a/b:c=d%e f'é", "x"), (1, "a/b:c=d%e f'é", "y"), (None, None, None), (2, "", "é")], "folder int, name string, value string")
    sinks.write_text_files(rows, str(tmp_path / "ours"))
    rows.write.partitionBy("folder", "name").text(str(tmp_path / "sparks"))

    def held(root):
        found = {}
        for f in sorted((tmp_path / root).rglob("*.txt")):
            found.setdefault(str(f.parent.relative_to(tmp_path / root)), []).extend(f.read_text(encoding="utf-8").split("\n")[:-1])
        return {k: sorted(v) for k, v in found.items()}

    assert held("ours") == held("sparks") and len(held("ours")) == 63
    group = f"g{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "files")
    sinks.write_text_files(rows, str(tmp_path / "again"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= 4 * spark.sparkContext.defaultParallelism
