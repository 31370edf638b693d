"""Detection metrics, ensembles, quality checks and rubrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detectors, effects, explain, metrics, quality, registry, windows
from ..sources.readers import table
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


#: Three detectors of labelled documents: length, commas and digits; the truth is toxicity or low quality.
_S = """s AS (SELECT d.doc_id, d.lang, d.source, CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END AS y, d.n_chars::DOUBLE AS score,
(length(text) - length(replace(text, ',', '')))::DOUBLE AS s2, (length(text) - length(replace(text, '.', '')))::DOUBLE AS s3 FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _scores(spark, d) -> DataFrame:
    text = F.col("text")
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    y = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)
    return rows.select("doc_id", "lang", "source", y.alias("y"), F.col("n_chars").cast("double").alias("score"), *[(F.length(text) - F.length(F.replace(text, F.lit(c)))).cast("double").alias(n) for n, c in (("s2", ","), ("s3", "."))])


_RATES = """round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
round((CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END + CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END) / 2, 6) AS balanced_accuracy"""
_PERCENTS = (80, 85, 90, 95, 97.5, 99)


def _sweep_sql(percents) -> str:
    return f"""WITH {_S}, th AS (SELECT unnest({list(map(float, percents))}::DOUBLE[]) AS percent, unnest((SELECT quantile_cont(score, {[p / 100 for p in percents]}) FROM s)) AS threshold),
c AS (SELECT percent, threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (score < threshold AND y = 0) AS tn, count(*) FILTER (score < threshold AND y = 1) AS fn FROM s, th GROUP BY ALL)
SELECT percent, threshold, tp, fp, tn, fn, {_RATES} FROM c"""


def _sweep(spark, d, percents) -> DataFrame:
    scores = _scores(spark, d).select("score", "y")
    thresholds = metrics.percentile_thresholds(scores, "score", list(percents))
    return thresholds.join(metrics.at_thresholds(scores, thresholds), "threshold").select("percent", "threshold", "tp", "fp", "tn", "fn", "precision", "recall", "f1", "accuracy", "balanced_accuracy")


@_query(_sweep_sql(_PERCENTS))
def threshold_sweep(spark, d):
    return _sweep(spark, d, _PERCENTS)


@_query(_sweep_sql(range(1, 100)))
def threshold_curve(spark, d):
    return _sweep(spark, d, range(1, 100))


@_query(f"WITH sw AS ({_sweep_sql(_PERCENTS)}) SELECT percent, threshold, f1 FROM sw ORDER BY f1 DESC, percent LIMIT 1")
def chosen_threshold(spark, d):
    return metrics.choose_threshold(_scores(spark, d).select("score", "y"), list(_PERCENTS)).select("percent", "threshold", "f1")


_AUC = """v AS (SELECT {by}, score, sum(y) AS p, count(*) - sum(y) AS n FROM s GROUP BY ALL), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v)
SELECT {by}, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives, round(CASE WHEN sum(p) * sum(n) = 0 THEN NULL ELSE sum(p * (below + n / 2)) / (sum(p) * sum(n)) END, 6) AS roc_auc FROM b GROUP BY {by}"""


@_query(f"WITH {_S}, {_AUC.format(by='lang')}")
def roc_auc_rank(spark, d):
    return metrics.roc_auc(_scores(spark, d), ["lang"])


_CURVE = """v AS (SELECT lang, score, sum(y) AS p, count(*) - sum(y) AS n FROM s GROUP BY ALL), c AS (SELECT lang, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY lang) AS ap, sum(n) OVER (PARTITION BY lang) AS an FROM v WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@_query(f"WITH {_S}, {_CURVE}, r AS (SELECT *, tp / ap AS tpr, tp / (tp + fp) AS pr FROM c) SELECT lang, round(sum(step * pr), 6) AS average_precision FROM (SELECT lang, pr, tpr - lag(tpr, 1, 0) OVER (PARTITION BY lang ORDER BY score DESC) AS step FROM r) GROUP BY lang")
def average_precision(spark, d):
    return metrics.average_precision(_scores(spark, d), ["lang"])


@_query(f"WITH {_S}, {_CURVE} SELECT lang, score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / ap, 6) AS tpr, round(fp / an, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM c")
def curve_points(spark, d):
    return metrics.curve(_scores(spark, d), ["lang"]).withColumns({c: F.round(c, 6) for c in ("tpr", "fpr", "precision")})


@_query(f"WITH {_S}, c AS (SELECT source, count(*) FILTER (y = 1 AND score >= 3000) AS tp, count(*) FILTER (y = 0 AND score >= 3000) AS fp, count(*) FILTER (y = 0 AND score < 3000) AS tn, count(*) FILTER (y = 1 AND score < 3000) AS fn FROM s GROUP BY 1) SELECT source, tp, fp, tn, fn, {', '.join(f'CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN {m} END AS {m}' for m in ('precision', 'recall', 'f1', 'accuracy', 'balanced_accuracy'))} FROM (SELECT *, {_RATES} FROM c)")
def family_metrics(spark, d):
    """Rates of each family; one that holds a single class has none."""
    return metrics.evaluate(_scores(spark, d), ["source"], F.col("y") == 1, F.col("score") >= 3000, both_classes=True)


@_query(f"WITH {_S}, h AS (SELECT *, ('0x' || substr(md5(source), 1, 8))::BIGINT % 2 AS fold FROM s WHERE source <> 'src0'), t AS (SELECT * FROM h x WHERE source NOT IN (SELECT source FROM h WHERE fold <> x.fold)), c AS (SELECT fold, count(*) FILTER (y = 1 AND score >= 3000) AS tp, count(*) FILTER (y = 0 AND score >= 3000) AS fp, count(*) FILTER (y = 0 AND score < 3000) AS tn, count(*) FILTER (y = 1 AND score < 3000) AS fn FROM t GROUP BY 1) SELECT *, {_RATES} FROM c")
def unseen_group_metrics(spark, d):
    """Two folds of sources, each judged as groups that the other has not seen; the background source is in neither."""
    fold = F.conv(F.substring(F.md5("source"), 1, 8), 16, 10).cast("long") % 2
    rows = _scores(spark, d).withColumn("fold", fold)
    parts = [metrics.unseen_groups(rows.filter(F.col("fold") == k), rows.filter(F.col("fold") == 1 - k), "source", ["src0"]) for k in (0, 1)]
    return metrics.evaluate(parts[0].unionByName(parts[1]), ["fold"], F.col("y") == 1, F.col("score") >= 3000)


_P = f"""{_S}, p AS (SELECT doc_id AS window_id, y AS y_true, m.name, (m.v >= m.cut)::INT AS y_pred, round(least(1, m.v / (2 * m.cut)), 6) AS score FROM s, LATERAL (VALUES ('length', score, 3000.0), ('commas', s2, 20.0), ('stops', s3, 50.0)) m(name, v, cut))"""


def _predictions(spark, d) -> DataFrame:
    rows = _scores(spark, d)
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("v"), F.lit(cut).alias("cut")) for n, c, cut in (("length", "score", 3000.0), ("commas", "s2", 20.0), ("stops", "s3", 50.0))])
    long = rows.select(F.col("doc_id").alias("window_id"), F.col("y").alias("y_true"), F.inline(each))
    return long.select("window_id", "y_true", "name", (F.col("v") >= F.col("cut")).cast("int").alias("y_pred"), F.round(F.least(F.lit(1.0), F.col("v") / (2 * F.col("cut"))), 6).alias("score"))


@_query(f"WITH {_P} SELECT window_id, max(y_true) AS y_true, CASE WHEN sum(y_pred) >= 2 THEN 1 ELSE 0 END AS y_pred, round(avg(score), 5) AS score, count(*) AS models FROM p GROUP BY 1")
def majority_vote(spark, d):
    return detectors.majority(_predictions(spark, d), digits=5)


@_query(f"WITH {_P} SELECT window_id, max(y_true) AS y_true, max(y_pred) AS y_pred, max(score) AS score, count(*) AS models FROM p GROUP BY 1")
def or_ensemble(spark, d):
    return detectors.or_ensemble(_predictions(spark, d))


@_query(f"WITH {_P}, c AS (SELECT name, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn FROM p GROUP BY 1) SELECT name, 'f1' AS metric, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS saved, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS recomputed, 'PASS' AS status FROM c")
def recompute_audit(spark, d):
    made = metrics.evaluate(_predictions(spark, d), ["name"], F.col("y_true") == 1, F.col("y_pred") == 1)
    saved = made.select(F.col("name").alias("name"), (F.col("f1") + 0.0).alias("f1"))
    return metrics.recompute_audit(saved, made.select("name", "f1"), "name", ["f1"]).select("name", "metric", "saved", "recomputed", "status")


_CHECKS = """SELECT * FROM (VALUES
('unique_o_orderkey', (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders), 'FAIL'), ('not_null_o_custkey', (SELECT count(*) FILTER (o_custkey IS NULL) FROM orders), 'FAIL'),
('range_o_totalprice', (SELECT count(*) FILTER (NOT o_totalprice BETWEEN 1000 AND 450000) FROM orders), 'WARN'), ('enum_o_orderstatus', (SELECT count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders), 'FAIL'),
('urgent_is_dear', (SELECT count(*) FILTER (o_orderpriority = '1-URGENT' AND NOT o_totalprice > 1000) FROM orders), 'FAIL')) t(check_name, violations, severity)"""
_RESULTS = f"r AS (SELECT check_name, violations, CASE WHEN violations = 0 THEN 'PASS' ELSE severity END AS status FROM ({_CHECKS}))"


def _checks(spark, d) -> DataFrame:
    return quality.run_checks(table(spark, d, "orders"), [
        quality.no_duplicates("o_orderkey"), quality.no_nulls("o_custkey"), quality.in_range("o_totalprice", 1000, 450000, "WARN"), quality.in_set("o_orderstatus", ["F", "O"]),
        quality.implies("urgent_is_dear", F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") > 1000),
    ])


@_query(f"WITH {_RESULTS} SELECT * FROM r")
def dq_suite(spark, d):
    return _checks(spark, d)


@_query(f"WITH {_RESULTS}, c AS (SELECT count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'WARN') AS warn, count(*) FILTER (status = 'FAIL') AS fail, count(*) AS total FROM r) SELECT *, round(pass / total, 6) AS pass_rate, CASE WHEN fail > 0 THEN 'FAIL' WHEN warn > 0 THEN 'WARN' ELSE 'PASS' END AS overall FROM c")
def dq_rollup(spark, d):
    return quality.rollup(_checks(spark, d))


@_query(f"WITH {_E}, n AS (SELECT event_type, t // 3600 AS h FROM e GROUP BY ALL), l AS (SELECT event_type, h, lead(h) OVER (PARTITION BY event_type ORDER BY h) AS x FROM n) SELECT event_type, count(*) FILTER (x - h <> 1) AS gaps FROM l GROUP BY 1")
def dq_gaps(spark, d):
    hours = _events(spark, d).select("event_type", F.floor(F.col("t") / 3600).alias("h")).distinct()
    return quality.gap_violations(hours, "h", 1, ["event_type"])


@_query("SELECT count(*) FILTER (l IS NULL) AS only_a, count(*) FILTER (o IS NULL) AS only_b, count(*) FILTER (o IS NOT NULL AND l IS NOT NULL) AS both FROM (SELECT o_orderkey AS o FROM orders) FULL JOIN (SELECT DISTINCT l_orderkey AS l FROM lineitem) ON o = l")
def dq_alignment(spark, d):
    return quality.alignment(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@_query(r"""SELECT conv_id, turn, regexp_matches(lower(text), '\b(packets?|ieee\s*2030\.5|modbus|dnp3|mqtt|payloads?|frames?|bytes?|registers?|protocol traces?)\b')::INT AS packet_claim_flag,
regexp_matches(lower(text), '\b(real\s+field|live\s+measurements?|actual\s+telemetry|real\s+telemetry|real\s+sensors?)\b')::INT AS field_telemetry_claim_flag,
regexp_matches(lower(text), '\b(hackers?|malware|exploit(s|ed)?|attackers?|threat\s+actors?|nation[\s-]states?|ransomware|apt\s*\d+)\b')::INT AS external_attacker_claim_flag,
(contains(text, 'pv35') OR contains(text, 'pv60') OR contains(text, 'pv83') OR contains(text, 'bess48') OR contains(text, 'bess108'))::INT AS uses_old_asset_name_flag, (turn = 3)::INT AS unsupported_claim_flag FROM conversations WHERE text IS NOT NULL""")
def regex_penalties(spark, d):
    rows = table(spark, d, "conversations").filter("text is not null")
    return rows.select("conv_id", "turn", *[c.alias(n) for n, c in explain.penalties(F.col("text"), {"unsupported_claim_flag": F.col("turn") == 3}).items()])


@_query("""WITH c AS (SELECT conv_id, turn, role, (length(text) > 200)::INT AS c1, (text LIKE '%.%')::INT AS c2, (turn > 0)::INT AS c3, (text LIKE '%,%')::INT AS c4, (length(text) > 2000)::INT AS p1, (text LIKE '%|%')::INT AS p2, role <> 'system' AS parsed FROM conversations WHERE text IS NOT NULL)
SELECT role, count(*) AS n, round(avg(CASE WHEN parsed THEN round(greatest(0, least(1, (c1 + c2 + c3 + c4) / 4 - 0.15 * (p1 + p2))), 6) ELSE 0 END), 5) AS mean_score, round(avg(c1), 6) AS long_share FROM c GROUP BY role""")
def rubric_score(spark, d):
    text = F.col("text")
    rows = table(spark, d, "conversations").filter("text is not null")
    checks = [x.cast("int") for x in (F.length(text) > 200, text.contains("."), F.col("turn") > 0, text.contains(","))]
    faults = [x.cast("int") for x in (F.length(text) > 2000, text.contains("|"))]
    made = rows.select("role", checks[0].alias("c1"), explain.overall_score(checks, faults, F.col("role") != "system").alias("score"))
    return made.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean_score"), F.round(F.avg("c1"), 6).alias("long_share"))


#: Signals out of the events: (event type, variable, divisor); and effects on each from every nation, of all types, units, directions and shapes.
_SIGNALS = (("view", "pv_p_kw", 1.0), ("signup", "bess_p_kw", 2.0), ("click", "pcc_p_kw", 0.5), ("error", "pcc_q_kvar", 1.0), ("purchase", "pcc_v_a_pu", 100.0))
_TYPES = ("absolute_delta", "relative_delta", "hold_stale", "bounded_clip", "smooth_oscillation", "delay_response", "stale_value_hold", "none")
_UNITS, _DIRECTIONS, _SHAPES = ("%", "kW", "none"), ("increase", "decrease", "none", "bidirectional"), ("ramp", "step", "hold")


@_query(f"""WITH RECURSIVE {_E}, sig AS MATERIALIZED (SELECT variable, t // 600 * 600 AS time_s, round(sum(value::DECIMAL(18,2))::DOUBLE / any_value(part), 6) AS value FROM e JOIN (VALUES {', '.join(map(str, _SIGNALS))}) m(event_type, variable, part) USING (event_type) GROUP BY 1, 2),
b(variable, lo, hi) AS (VALUES ('pv_p_kw', 0.0::DOUBLE, 100.0::DOUBLE), ('bess_p_kw', -50.0, 50.0), ('pcc_p_kw', -250.0, 250.0), ('pcc_q_kvar', -150.0, 150.0), ('pcc_v_a_pu', 0.9, 1.1)),
fx AS MATERIALIZED (SELECT k, variable AS w, lo, hi, {list(_TYPES)}[k % 8 + 1] AS type, abs(k * 37 % 90 - 20)::DOUBLE AS size, {list(_UNITS)}[k % 3 + 1] AS unit, CASE WHEN k % 4 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS sign, {list(_SHAPES)}[k // 3 % 3 + 1] AS shape, k % 5 * 1800 AS ramp, k * 40507 % 2500000 AS s, k * 40507 % 2500000 + 7200 + k * 7717 % 200000 AS x
FROM (SELECT n_nationkey::BIGINT * 5 + i - 1 AS k, [{', '.join(f"'{v}'" for _, v, _ in _SIGNALS)}][i] AS variable FROM nation, range(1, 6) r(i)) JOIN b USING (variable)),
st AS (SELECT 0::BIGINT AS k, variable, time_s, value, value AS v, 0 AS effects FROM sig UNION ALL
SELECT k + 1, variable, time_s, value, CASE WHEN hit THEN least(hi, greatest(lo, CASE WHEN type = 'absolute_delta' THEN v + sign * size * f WHEN type = 'relative_delta' THEN v * (1 + sign * CASE WHEN unit = '%' THEN size / 100 ELSE size END * f) WHEN type IN ('hold_stale', 'stale_value_hold') THEN first
WHEN type = 'bounded_clip' THEN least(v, size) WHEN type = 'smooth_oscillation' THEN v + size * sin(2 * pi() * (time_s - s) / least(120, greatest(30, x - s))) WHEN type = 'delay_response' THEN coalesce(late, v) ELSE v END)) ELSE v END, effects + hit::INT
FROM (SELECT *, first_value(v) OVER (PARTITION BY variable, hit ORDER BY time_s) AS first, last_value(v) OVER (PARTITION BY variable, hit ORDER BY time_s RANGE BETWEEN UNBOUNDED PRECEDING AND ramp PRECEDING) AS late, CASE WHEN shape = 'ramp' AND ramp > 0 THEN least(1, greatest(0, (time_s - s)::DOUBLE / ramp)) ELSE 1 END AS f
FROM (SELECT st.*, fx.* EXCLUDE (k), variable = w AND time_s >= s AND time_s < x AS hit FROM st JOIN fx ON fx.k = st.k)))
SELECT variable, time_s, value, effects, round(v, 6) AS changed FROM st WHERE k = (SELECT max(k) + 1 FROM fx)""")
def effect_fold(spark, d):
    """Ten-minute signals under effects of all types, which hold and delay what earlier ones left."""
    part = F.lit(None).cast("double")
    variable = F.lit(None).cast("string")
    for kind, name, divisor in _SIGNALS:
        part, variable = F.when(F.col("event_type") == kind, divisor).otherwise(part), F.when(F.col("event_type") == kind, name).otherwise(variable)
    rows = _events(spark, d).withColumns({"variable": variable, "part": part, "time_s": F.floor(F.col("t") / 600) * 600}).filter("variable is not null")
    signals = rows.groupBy("time_s", "variable").agg(F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.first("part"), 6).alias("value"))
    k, pick = F.col("k"), lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    nations = table(spark, d, "nation").select("n_nationkey", F.posexplode(F.array(*[F.lit(v) for _, v, _ in _SIGNALS])).alias("i", "variable"))
    nations = nations.withColumn("k", F.col("n_nationkey").cast("long") * 5 + F.col("i"))
    fx = nations.select("variable", k.alias("effect_order"), pick(_TYPES, k % 8).alias("type"), (k * 37 % 90 - 20).cast("double").alias("magnitude"), pick(_UNITS, k % 3).alias("unit"), pick(_DIRECTIONS, k % 4).alias("direction"),
                        pick(_SHAPES, F.floor(k / 3) % 3).alias("shape"), (k % 5 * 1800).cast("int").alias("ramp_s"), (k * 40_507 % 2_500_000).alias("start_s"), (k * 40_507 % 2_500_000 + 7200 + k * 7717 % 200_000).alias("end_s"))
    made = effects.apply_effects(signals, fx, 7200)
    return made.select("variable", "time_s", "value", "effects", F.round("changed", 6).alias("changed"))


@_query(f"WITH {_S}, x AS (SELECT CASE WHEN lang IN ('en', 'fr', 'de') THEN lang ELSE 'unknown' END AS truth, CASE WHEN score > 4000 THEN 'en' WHEN score > 2000 THEN 'fr' WHEN score > 1000 THEN 'de' ELSE 'unknown' END AS p FROM s) SELECT truth, {', '.join(f"count(*) FILTER (p = '{c}') AS {c}" for c in ('en', 'fr', 'de', 'unknown'))} FROM x GROUP BY 1")
def class_confusion(spark, d):
    guess = F.when(F.col("score") > 4000, "en").when(F.col("score") > 2000, "fr").when(F.col("score") > 1000, "de").otherwise("none of them")
    return metrics.class_confusion(_scores(spark, d).withColumn("guess", guess), "lang", "guess", ["en", "fr", "de"])


@_query(f"""WITH {_E}, r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, event_type = 'error' AS y, value >= 80 AS p FROM e),
g AS (SELECT user_id, count(*) AS n, min(i) FILTER (y) AS onset, min(i) FILTER (y AND p) AS hit FROM r GROUP BY user_id), l AS (SELECT user_id % 5 AS model, coalesce(hit - onset, n - onset) AS latency FROM g WHERE onset IS NOT NULL)
SELECT model, count(*) AS n, round(avg(latency), 6) AS mean, quantile_cont(latency, 0.5)::DOUBLE AS median, min(latency) AS low, max(latency) AS high, count(*) FILTER (latency = 0) AS zeros FROM l GROUP BY 1""")
def latency_summary(spark, d):
    made = windows.detection_latency(_events(spark, d), "user_id", ["t", "event_id"], F.col("event_type") == "error", F.col("value") >= 80)
    rows = made.select((F.col("user_id") % 5).alias("model"), F.col("latency").cast("long").alias("latency"))
    return metrics.summary(rows, ["model"], "latency")


@_query(f"""WITH {_P}, g AS (SELECT name, y_true AS y, score, CASE name WHEN 'length' THEN 0 WHEN 'commas' THEN 1 ELSE 2 END AS place FROM p),
c AS (SELECT name, place, q.i, quantile_cont(score, q.p) OVER (PARTITION BY name) AS threshold, score, y FROM g, (VALUES (0, 0.8), (1, 0.9), (2, 0.95)) q(i, p)),
k AS (SELECT name, place, i, threshold, count(*) FILTER (y = 1 AND score >= threshold) AS tp, count(*) FILTER (y = 0 AND score >= threshold) AS fp, count(*) FILTER (y = 0 AND score < threshold) AS tn, count(*) FILTER (y = 1 AND score < threshold) AS fn FROM c GROUP BY ALL),
r AS (SELECT name, place, i, tp, fp, tn, fn, round(threshold, 6) AS threshold, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM k) SELECT name, threshold, tp, fp, tn, fn, f1 FROM r ORDER BY f1 DESC, place, i LIMIT 1""".replace("quantile_cont(score, q.p) OVER (PARTITION BY name)", "(SELECT quantile_cont(h.score, [0.8, 0.9, 0.95])[q.i + 1] FROM g h WHERE h.name = g.name)"))
def best_configuration(spark, d):
    place = F.when(F.col("name") == "length", 0).when(F.col("name") == "commas", 1).otherwise(2)
    rows = _predictions(spark, d).select("name", F.col("y_true").alias("y"), "score", place.alias("place"))
    return metrics.best_configuration(rows, "name", "place").select("name", F.round("threshold", 6).alias("threshold"), "tp", "fp", "tn", "fn", "f1")


@_query()
def pca_reconstruction(spark, d):
    """Reconstruction errors of window features on two components."""
    made = windows.window_features(_events(spark, d), "t", ["value"], 7200, 3600, "event_id", digits=6)
    features = ["mean", "std", "max", "rms", "median"]
    scaled = detectors.standardize(made, detectors.standard_parameters(made, features))
    return detectors.pca_error(scaled, features, detectors.pca_basis(scaled, features, 2)).select("window_id", F.round("score", 6).alias("score"))


@_query()
def isolation_forest(spark, d):
    """Isolation scores of window features."""
    made = windows.window_features(_events(spark, d), "t", ["value"], 7200, 3600, "event_id", digits=6).select("window_id", "mean", "std", "max", "rms")
    features = ["mean", "std", "max", "rms"]
    forest = detectors.fit_isolation_forest(made, features, "window_id")
    return detectors.score_rows(made, features, forest.score).select("window_id", F.round("score", 9).alias("score"))


@_query()
def stacked_scores(spark, d):
    """Logistic stacking of three scores in two folds: even and odd documents are each scored by the model of the others."""
    rows = _scores(spark, d).select("doc_id", "y", *[(F.col(c) / k).alias(c) for c, k in (("score", 10000.0), ("s2", 100.0), ("s3", 100.0))])
    even, odd = rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 <> 0")
    made = [detectors.stacked(a, b, ["score", "s2", "s3"], "y", name="stacked").select("doc_id", "y", "stacked") for a, b in ((even, odd), (odd, even))]
    made = made[0].unionByName(made[1])
    return made.select("doc_id", "y", F.round("stacked", 4).alias("stacked"))


@_query(f"""WITH {_E}, n AS (SELECT count(*) AS n FROM e) SELECT 'robust_z' AS model_name, 'PASS' AS status, NULL::VARCHAR AS failure_reason, n AS scored FROM n UNION ALL SELECT 'standard_z', 'PASS', NULL, n FROM n UNION ALL SELECT 'ocsvm', 'NOT_RUN', 'No module named ''a_kernel_library''', NULL UNION ALL SELECT 'flat', 'FAILED', 'ValueError: no scale', NULL""")
def not_run_rows(spark, d):
    """Models fitted and run one by one: a missing library and any other failure leave a row that says so."""
    rows = _events(spark, d).select("event_id", "value", (F.col("t") % 3600).cast("double").alias("phase"))
    z = lambda name: lambda: registry.scores(rows, registry.z_models(rows, ["value", "phase"]).filter(F.col("model_name") == name), ["event_id"])

    def missing():
        import a_kernel_library  # noqa: F401

    def broken():
        raise ValueError("no scale")

    return registry.attempted(spark, {"robust_z": z("robust_z"), "standard_z": z("standard_z"), "ocsvm": missing, "flat": broken})