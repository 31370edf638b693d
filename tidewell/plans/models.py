"""Frozen models, sequence tables, suites over scenarios and documents of evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calls, detectors, effects, explain, metrics, quality, registry, windows
from ..operators.intervals import settled
from ..sources import sinks
from ..sources.readers import table
from .detection import _P, _predictions
from .site import _SC, _scenarios
from .timeseries import _E, _events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_X = f"{_E}, x AS (SELECT event_id, value, (t % 3600)::DOUBLE AS phase, (event_type = 'error')::INT AS y FROM e), tr AS (SELECT * FROM x WHERE event_id % 2 = 0)"


@_query(f"""WITH {_X}, med AS (SELECT quantile_cont(value, 0.5) AS a, quantile_cont(phase, 0.5) AS b FROM tr), mad AS (SELECT quantile_cont(abs(value - a), 0.5) AS a, quantile_cont(abs(phase - b), 0.5) AS b FROM tr, med),
st AS (SELECT avg(value) AS ma, stddev_pop(value) AS sa, avg(phase) AS mb, stddev_pop(phase) AS sb FROM tr),
s AS (SELECT event_id, 'robust_z' AS model_name, greatest(abs(value - med.a) / (1.4826 * mad.a + 1e-8), abs(phase - med.b) / (1.4826 * mad.b + 1e-8)) AS score FROM x, med, mad UNION ALL SELECT event_id, 'standard_z', greatest(abs((value - ma) / (sa + 1e-8)), abs((phase - mb) / (sb + 1e-8))) FROM x, st),
c AS (SELECT model_name, quantile_cont(score, 0.9) AS threshold FROM s WHERE event_id % 2 = 0 GROUP BY 1)
SELECT event_id, model_name, round(score, 6) AS score, (score >= threshold - 1e-9)::INT AS y_pred, NULL::VARCHAR AS failure_reason FROM s JOIN c USING (model_name) UNION ALL SELECT NULL, 'ocsvm', NULL, NULL, 'no kernel library'""")
def frozen_scores(spark, d):
    """Models fitted on some events score all of them, with thresholds frozen when they were fitted; one that could not be leaves a row that says so."""
    rows = _events(spark, d).select("event_id", "value", (F.col("t") % 3600).cast("double").alias("phase"))
    train = rows.filter("event_id % 2 = 0")
    fitted = registry.z_models(train, ["value", "phase"]).filter("kind = 'z'").unionByName(registry.not_run(spark, "ocsvm", "no kernel library"))
    cuts = metrics.percentiles_by(registry.scores(train, fitted, ["event_id"]), ["model_name", "config"], "score", [90])
    cuts = cuts.select("model_name", "config", F.col("percentiles")[0].alias("threshold"), F.lit(True).alias("selected"))
    return registry.judge(rows, registry.frozen(fitted, cuts, sinks.scratch(spark, "models")), "event_id")


_FEATURES = ["mean", "std", "min", "max", "median", "slope", "rms"]


def _windows(spark, d: str) -> DataFrame:
    """Hourly windows of the events with their features, a label (many errors) and their part: 0 to train, 1 to choose, 2 to judge."""
    rows = _events(spark, d)
    made = windows.window_features(rows, "t", ["value"], 7200, 3600, "event_id", digits=6)
    errors = windows.hopping(rows.select("t", (F.col("event_type") == "error").cast("double").alias("bad")), "t", 7200, 3600).groupBy("window_id").agg((F.avg("bad") > 0.35).cast("int").alias("y"))
    return settled(made.join(errors, "window_id").withColumn("part", F.when(F.col("window_id") % 5 < 3, 0).otherwise(F.col("window_id") % 5 - 2).cast("int")), "windows")


def _grid(spark, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All models of the grids, and their thresholds by the second part."""
    train = rows.filter("part = 0 and y = 0")
    fitted = registry.z_models(train, _FEATURES).unionByName(registry.pca_models(train, _FEATURES, (*registry.BASES[:3], ("components_2", 2), ("components_5", 5), ("components_10", 10))))
    fitted = settled(fitted.unionByName(registry.forest_models(train, _FEATURES, "window_id")).unionByName(registry.not_run(spark, "lstm_autoencoder", "no neural library")), "models")
    return fitted, settled(registry.thresholds(registry.scores(rows.filter("part = 1"), fitted, ["y"])), "thresholds")


@_query()
def model_grid(spark, d):
    """Six forests, bases and three distances fitted side by side; of each its best threshold, of each model its best configuration."""
    return _grid(spark, _windows(spark, d))[1].select("model_name", "config", F.round("threshold", 6).alias("threshold"), "tp", "fp", "tn", "fn", "f1", "selected")


@_query()
def registry_scores(spark, d):
    """The chosen models and a stacked one score the last part with frozen thresholds, in one pass."""
    rows = _windows(spark, d)
    fitted, cuts = _grid(spark, rows)
    path = sinks.scratch(spark, "registry")
    chosen = registry.frozen(fitted, cuts, path)
    part = rows.filter("part = 1")
    both = registry.scores(part, chosen, ["window_id", "y"])
    stacked = registry.stacked_model(both, "window_id", "y")
    with_stacked = chosen.drop("threshold").unionByName(stacked)
    cut = registry.thresholds(registry.scores(part, with_stacked, ["y"]).filter("model_name = 'stacked'"))
    registry.frozen(stacked, cut, path)
    return registry.judge(rows.filter("part = 2"), spark.read.parquet(path), "window_id")


_W = f"""{_E}, lim AS (SELECT (max(t) + 1 - 7200) // 3600 AS hi FROM e), w AS (SELECT e.*, unnest(range(greatest(0, CAST(ceil((t - 7199) / 3600.0) AS BIGINT)), least(t // 3600, hi) + 1)) AS window_id FROM e, lim)"""


@_query(f"WITH {_W} SELECT window_id, count(*)::INT AS n, arg_min(value, (t, event_id)) AS first, arg_max(value, (t, event_id)) AS last FROM w WHERE window_id % 5 = 4 GROUP BY 1")
def sequence_round_trip(spark, d):
    """Window sequences as a partitioned table of arrays, of which one split is read."""
    path = sinks.scratch(spark, "sequences")
    made = windows.tensor(_events(spark, d), "t", "event_id", "value", 7200, 3600)
    sinks.write_table(made.withColumn("split", F.when(F.col("window_id") % 5 == 4, "test").otherwise("train")), path, ["split"])
    rows = spark.read.parquet(path).filter("split = 'test'")
    return rows.select("window_id", F.size("steps").alias("n"), F.element_at("steps", 1).alias("first"), F.element_at("steps", -1).alias("last"))


@_query(f"WITH {_P} SELECT window_id, round(max(score) FILTER (name = 'length'), 6) AS length, round(max(score) FILTER (name = 'commas'), 6) AS commas FROM p GROUP BY 1 HAVING count(DISTINCT name) FILTER (name IN ('length', 'commas')) = 2")
def score_pivot(spark, d):
    """A column for each model's score, of rows that all models have scored."""
    return detectors.score_columns(_predictions(spark, d), "window_id", ["length", "commas"])


@_query(f"""WITH {_P}, m AS (SELECT name, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn FROM p GROUP BY 1),
b AS (SELECT name FROM m ORDER BY round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) DESC, name LIMIT 2)
SELECT window_id, max(y_true) AS y_true, CASE WHEN sum(y_pred) >= 2 THEN 1 ELSE 0 END AS y_pred, round(avg(score), 8) AS score, count(*) AS models FROM p WHERE name IN (SELECT name FROM b) GROUP BY 1""")
def vote_of_the_best(spark, d):
    """The vote of the models with the best F1."""
    return detectors.vote_of_best(_predictions(spark, d), "name", "window_id", best=2, votes=2, digits=8)


@_query(f"""WITH {_E}, s AS (SELECT event_id, md5('5:' || event_id) AS h, event_type IN ('error', 'purchase') AS bad FROM e) SELECT event_id, round(CASE WHEN bad THEN 0.55 + 0.40 * u ELSE 0.05 + 0.40 * u END, 4) AS score, bad::INT AS y_pred FROM (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM s)""")
def smoke_scores(spark, d):
    """Scores above the threshold for anomalies, below it for the rest, drawn by a hash of the id."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit("5:"), F.col("event_id").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return _events(spark, d).select("event_id", *[x.alias(n) for n, x in detectors.smoke(F.col("event_type").isin("error", "purchase"), u).items()])


@_query("""SELECT k, CASE WHEN k % 10 < 3 THEN v * 2 ELSE v END AS v, CASE WHEN k % 10 < 3 THEN CASE WHEN k % 10 = 0 THEN 'resolved' ELSE 'surrogate' END ELSE m END AS method FROM (SELECT o_orderkey AS k, o_totalprice AS v, 'surrogate' AS m FROM orders)""")
def rows_written_back(spark, d):
    """Rows that another run has resolved replace those of the table; a method that is not allowed falls back."""
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.lit("surrogate").alias("method"))
    resolved = base.filter("k % 10 < 3").select("k", (F.col("v") * 2).alias("v"), F.when(F.col("k") % 10 == 0, "resolved").otherwise("guess").alias("method"))
    return effects.write_back(base, resolved, "k", ["v"], "method", ["resolved", "surrogate"], "surrogate")


@_query(f"""WITH {_SC}, l AS (SELECT *, CASE WHEN scenario_class = 'normal' THEN 0 ELSE 1 END AS label, start_time_s + CASE WHEN scenario_id % 50 = 0 THEN -5 ELSE delay END AS applied FROM sd),
r(check_name, violations, severity) AS (SELECT 'unique_scenario_id', count(*) - count(DISTINCT scenario_id), 'FAIL' FROM l UNION ALL SELECT 'command_before_effect', count(*) FILTER (scenario_class = 'cyber_physical' AND applied < start_time_s), 'FAIL' FROM l
UNION ALL SELECT 'normal_is_unlabelled', count(*) FILTER (scenario_class = 'normal' AND label <> 0), 'FAIL' FROM l UNION ALL SELECT 'range_start_time_s', count(*) FILTER (NOT start_time_s BETWEEN 0 AND 604799), 'FAIL' FROM l
UNION ALL SELECT 'ends_in_week', count(*) FILTER (e > 604799), 'WARN' FROM l UNION ALL SELECT 'has_rows_for_each_scenario', count(*) FILTER (scenario_id % 97 = 0), 'FAIL' FROM l)
SELECT check_name, violations, CASE WHEN violations = 0 THEN 'PASS' ELSE severity END AS status FROM r""")
def causality_suite(spark, d):
    """Scenarios against their labels, times and lifecycle rows."""
    c = F.col
    ramp = F.when(c("ramp_s") > 0, c("ramp_s")).otherwise(F.floor(c("duration_s") / 4))
    delay = F.when(c("scenario_id") % 50 == 0, -5).otherwise(F.when(c("scenario_family").contains("delay"), F.greatest(F.lit(30), ramp)).otherwise(0))
    rows = _scenarios(spark, d).withColumns({"label": (c("scenario_class") != "normal").cast("int"), "command_apply_time_s": c("start_time_s") + delay, "end_time_s": c("start_time_s") + c("duration_s") - 1})
    log = rows.filter("scenario_id % 97 <> 0").select("scenario_id").distinct()
    return quality.causality_suite(rows, log, "scenario_id", 604_800)


@_query(f"""WITH {_E}, d AS (SELECT k AS detection_id, k * 86400 AS s, k * 86400 + 3599 AS x, ['normal', 'cyber_only'][k % 2 + 1] AS kind FROM (SELECT unnest(range(0, max(t) // 86400 + 1)) AS k FROM e)), j AS (SELECT detection_id, kind, event_type, value, event_id, t FROM d LEFT JOIN e ON t BETWEEN s AND x)
SELECT detection_id, kind, CASE kind WHEN 'normal' THEN 'No anomaly. Normal monitoring.' ELSE 'Cyber flags active but no physical effect.' END AS timing, round(avg(value), 4) AS mean, round(avg((event_type = 'error')::INT), 4) AS cyber, count(value) AS points FROM j GROUP BY detection_id, kind""")
def evidence_packets(spark, d):
    """One nested document a detection: what it is, its signals, its cyber evidence and what both say; read back out of the JSON."""
    rows = _events(spark, d)
    aligned = rows.select(F.col("t").alias("time_s"), F.col("event_type").alias("cyber_state"), F.col("event_type").alias("cyber_lifecycle_stage"), (F.col("event_type") == "error").cast("int").alias("cyber_anomaly_active"), "value")
    kind = F.when(F.col("id") % 2 == 0, "normal").otherwise("cyber_only")
    days = (rows.agg(F.max("t")).first()[0] or 0) // 86_400 + 1
    hits = spark.range(days).select(F.col("id").alias("detection_id"), (F.col("id") * 86_400).alias("window_start_s"), (F.col("id") * 86_400 + 3599).alias("window_end_s"), kind.alias("scenario_class"))
    made = explain.packets(hits, explain.signal_evidence(hits, aligned, ["value"], 3600), explain.cyber_evidence(hits, aligned, [], 3600))
    get = lambda path: F.get_json_object("packet", path)
    return made.select("detection_id", get("$.detection.scenario_class").alias("kind"), get("$.expected_vs_actual.timing_relationship_observed").alias("timing"), F.round(get("$.physical_evidence[0].mean").cast("double"), 4).alias("mean"),
                       get("$.cyber_evidence.cyber_fraction").cast("double").alias("cyber"), F.coalesce(get("$.physical_evidence[0].points").cast("long"), F.lit(0)).alias("points"))


@_query(f"WITH {_E}, u AS (SELECT event_type AS component, t // 43200 AS block, value FROM e), n AS (SELECT (max(t) + 1) // 43200 AS whole FROM e) SELECT component, block, round(avg(value), 6) AS mean, count(*) AS n FROM u, n WHERE block < whole GROUP BY ALL")
def component_profiles(spark, d):
    """Block means of each component's series; the unfinished last block is left out."""
    return windows.downsample(_events(spark, d).withColumnRenamed("event_type", "component"), "t", "value", 43_200, ["component"]).select("component", "block", F.round("mean", 6).alias("mean"), "n")


def _stub(prompt: str) -> str:
    """A deterministic client: what it answers, and whether only after a repair, depends on the length of the prompt."""
    asked, _, again = prompt.partition("\n" + calls.REPAIR[:20])
    turn = len(asked) % 9
    if turn == 0 or (turn == 3 and again):
        raise OSError("no answer")
    if turn == 1 or (turn in (2, 3) and not again):
        return "I cannot say." if turn == 1 else '{"explanation_type": "normal", '
    if turn == 4:
        return '["normal"]'
    if turn == 5:
        return '```json\n{"explanation_type": "alien", "primary_physical_signals": "pv_p_kw", "confidence": 3}\n```'
    return 'Here: {"explanation_type": "cyber_only", "primary_physical_signals": ["a", "b"], "packet_level_claim_made": true, "confidence": "high"} as asked.'


@_query("""WITH c AS (SELECT conv_id, turn, length(coalesce(text, '')) % 9 AS k FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'FAILED_CALL_ERROR' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'OK_REPAIRED' WHEN 3 THEN 'FAILED_REPAIR_CALL_ERROR' WHEN 4 THEN 'FAILED' ELSE 'OK' END AS parse_status, CASE WHEN k IN (0, 3) THEN 'OSError: no answer' END AS error,
CASE WHEN k IN (0, 1, 3, 4) THEN NULL WHEN k = 5 THEN 'insufficient_evidence' ELSE 'cyber_only' END AS explanation_type, CASE WHEN k IN (0, 1, 3, 4) THEN NULL WHEN k = 5 THEN 'low' ELSE 'high' END AS confidence,
CASE WHEN k IN (0, 1, 3, 4) THEN NULL WHEN k = 5 THEN 'pv_p_kw' ELSE 'a,b' END AS signals, CASE WHEN k IN (0, 1, 3, 4) THEN NULL ELSE k <> 5 END AS packet_claim FROM c""")
def called_explanations(spark, d):
    """Every turn as a prompt of a text client: parsed, repaired once where the parse fails, with failures as statuses."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    made, p = calls.explanations(rows, _stub, model="stub"), F.col("parsed")
    return made.select("conv_id", "turn", "parse_status", "error", p["explanation_type"].alias("explanation_type"), p["confidence"].alias("confidence"), F.array_join(p["primary_physical_signals"], ",").alias("signals"), p["packet_level_claim_made"].alias("packet_claim"))
