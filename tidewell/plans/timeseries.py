"""Windows, intervals and lifecycles over the event stream, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeaxis import iso, seconds_since
from ..operators import detectors, explain, intervals, lifecycle, metrics, windows
from ..operators.intervals import Interval
from ..sources.readers import table

BASE = "2024-01-01 00:00:00"
WIDTH, STRIDE = 7200, 3600
_E = "e AS (SELECT event_id, date_diff('second', TIMESTAMP '2024-01-01', ts) AS t, user_id, event_type, value, props FROM events)"
#: Window numbers of each event: full windows only.
_W = f"""{_E}, lim AS (SELECT (max(t) + 1 - {WIDTH}) // {STRIDE} AS hi FROM e),
w AS (SELECT e.*, unnest(range(greatest(0, CAST(ceil((t - {WIDTH} + 1) / {STRIDE}.0) AS BIGINT)), least(t // {STRIDE}, hi) + 1)) AS window_id FROM e, lim)"""


def _events(spark, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("t", seconds_since(F.col("ts"), BASE))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_STATS = """round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS median,
round(CASE WHEN var_pop(t) > 0 THEN regr_slope(value, t) ELSE 0 END, 6) AS slope, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last,
round(arg_max(value, event_id) - arg_min(value, event_id), 6) AS delta, round(sqrt(avg(value * value)), 6) AS rms"""


@_query(f"WITH {_W} SELECT window_id, window_id * {STRIDE} AS window_start_s, count(*) AS n, {_STATS} FROM w GROUP BY window_id")
def hopping_features(spark, d):
    return windows.window_features(_events(spark, d), "t", ["value"], WIDTH, STRIDE, "event_id", digits=6)


_FEATURES = ("mean", "std", "max", "rms")


@_query(f"""WITH {_W}, f AS (SELECT window_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, max(value) AS max, round(sqrt(avg(value * value)), 6) AS rms FROM w GROUP BY window_id),
m AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in _FEATURES)} FROM f),
s AS (SELECT {', '.join(f'quantile_cont(abs(f.{c} - m.{c}), 0.5) AS {c}' for c in _FEATURES)} FROM f, m),
z AS (SELECT f.window_id, f.n, round(greatest({', '.join(f'abs(f.{c} - m.{c}) / (1.4826 * s.{c} + 1e-8)' for c in _FEATURES)}), 6) AS score FROM f, m, s),
q AS (SELECT quantile_cont(score, 0.95) AS threshold FROM z)
SELECT window_id, n, score, score >= threshold AS flagged FROM z, q""")
def robust_z_anomaly(spark, d):
    # read by several passes for percentiles: written once
    made = intervals.settled(windows.window_features(_events(spark, d), "t", ["value"], WIDTH, STRIDE, "event_id", digits=6), "windows")
    scored = detectors.robust_z(made, detectors.robust_parameters(made, list(_FEATURES))).withColumn("score", F.round("score", 6))
    threshold = metrics.percentile_thresholds(scored, "score", [95]).first()["threshold"]
    return scored.select("window_id", "n", "score", (F.col("score") >= F.lit(threshold)).alias("flagged"))


@_query(f"""WITH {_W}, c AS (SELECT window_id, event_type, count(*) AS n, min(event_id) AS f FROM w GROUP BY ALL)
SELECT window_id, arg_min(event_type, f - n * 1000000000) AS dominant, max(n) AS votes FROM c GROUP BY window_id""")
def dominant_value(spark, d):
    return windows.dominant(windows.hopping(_events(spark, d), "t", WIDTH, STRIDE), ["window_id"], "event_type", "event_id")


@_query(f"WITH {_E} SELECT event_id, user_id, round(coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id), 0), 6) AS ramp FROM e")
def lag_ramp(spark, d):
    made = windows.ramp(_events(spark, d), ["user_id"], ["t", "event_id"], "value")
    return made.select("event_id", "user_id", F.round("ramp", 6).alias("ramp"))


@_query(f"WITH {_E}, n AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS next_t FROM e) SELECT user_id, t, next_t, next_t - t AS gap FROM n WHERE next_t - t > 43200")
def gap_check(spark, d):
    return windows.gaps(_events(spark, d).select("user_id", "t"), ["user_id"], "t", 43_200)


@_query(f"WITH {_E}, r AS (SELECT event_id, row_number() OVER (ORDER BY t, event_id) - 1 AS i, count(*) OVER () AS n FROM e) SELECT event_id, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM r")
def time_split(spark, d):
    return windows.time_split(_events(spark, d).select("event_id", "t"), ["t", "event_id"], F.floor(F.col("t") / 3600)).select("event_id", "split")


@_query(f"WITH {_E}, f AS (SELECT user_id, min(t) AS first_t FROM e GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY first_t, user_id) - 1 AS rank, count(*) OVER () AS n FROM f) SELECT user_id, first_t, rank, CASE WHEN rank < floor(n * 0.6) THEN 'train' WHEN rank < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM r")
def group_split(spark, d):
    return windows.group_split(_events(spark, d), "user_id", "t").withColumn("rank", F.col("rank").cast("long"))


@_query(f"""WITH {_E}, r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, event_type = 'error' AS y, value >= 80 AS p FROM e),
g AS (SELECT user_id, count(*) AS n, min(i) FILTER (y) AS onset, min(i) FILTER (y AND p) AS detected FROM r GROUP BY user_id)
SELECT user_id, onset, detected, coalesce(detected - onset, n - onset) AS latency FROM g WHERE onset IS NOT NULL""")
def detection_latency(spark, d):
    made = windows.detection_latency(_events(spark, d), "user_id", ["t", "event_id"], F.col("event_type") == "error", F.col("value") >= 80)
    return made.select("user_id", *[F.col(c).cast("long").alias(c) for c in ("onset", "detected", "latency")])


@_query(f"""WITH {_E}, lim AS (SELECT (max(t) + 1) // 3600 AS hi FROM e)
SELECT t // 3600 AS block, round(avg(value), 6) AS mean, count(*) AS n FROM e, lim WHERE t // 3600 < hi GROUP BY ALL""")
def downsample_blocks(spark, d):
    return windows.downsample(_events(spark, d), "t", "value", 3600).withColumn("mean", F.round("mean", 6))


@_query(f"WITH {_E}, r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, greatest(1, ceil(count(*) OVER (PARTITION BY user_id) / 20.0)) AS k FROM e) SELECT event_id, user_id FROM r WHERE i % k = 0")
def stride_sample(spark, d):
    return windows.every_nth(_events(spark, d), ["user_id"], ["t", "event_id"], 20).select("event_id", "user_id")


@_query(f"WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM e) SELECT user_id, event_id, event_type, value FROM r WHERE r = 1")
def best_per_group(spark, d):
    return windows.best_per_group(_events(spark, d), ["user_id"], F.desc("value"), F.asc("event_id")).select("user_id", "event_id", "event_type", "value")


@_query(f"""WITH RECURSIVE {_E}, r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, CASE WHEN event_type = 'purchase' THEN -value ELSE value / 10 END AS d FROM e),
l AS (SELECT user_id, 0::BIGINT AS i, 50.0::DOUBLE AS level FROM (SELECT DISTINCT user_id FROM r)
UNION ALL SELECT r.user_id, r.i, least(100.0, greatest(0.0, l.level + r.d)) FROM l JOIN r ON r.user_id = l.user_id AND r.i = l.i + 1)
SELECT user_id, max(i) AS steps, round(arg_max(level, i), 6) AS level FROM l GROUP BY user_id""")
def running_clamped(spark, d):
    step = F.when(F.col("event_type") == "purchase", -F.col("value")).otherwise(F.col("value") / 10)
    made = windows.clamped_total(_events(spark, d), ["user_id"], ["t", "event_id"], step, 50.0, 0.0, 100.0, F.floor(F.col("t") / 86_400))
    return made.select("user_id", F.col("steps").cast("long").alias("steps"), F.round("level", 6).alias("level"))


@_query(f"""WITH RECURSIVE {_E}, r AS (SELECT user_id, t, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, CASE WHEN event_type = 'purchase' THEN -value ELSE value / 10 END AS d FROM e),
l AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS t, 0::BIGINT AS event_id, 50.0::DOUBLE AS level FROM (SELECT DISTINCT user_id FROM r)
UNION ALL SELECT r.user_id, r.i, r.t, r.event_id, least(100.0, greatest(0.0, l.level + r.d)) FROM l JOIN r ON r.user_id = l.user_id AND r.i = l.i + 1)
SELECT user_id, t, event_id, round(level, 6) AS level FROM l WHERE i > 0""")
def clamped_series(spark, d):
    """The clamped total after each event, not only its end."""
    step = windows.clamp(F.when(F.col("event_type") == "purchase", -F.col("value")).otherwise(F.col("value") / 10), 0.0, 100.0)
    made = windows.level_series(_events(spark, d), ["user_id"], ["t", "event_id"], F.floor(F.col("t") / 86_400), step, windows.clamps(), 50.0)
    return made.withColumn("level", F.round("level", 6))


@_query(f"""WITH RECURSIVE {_E}, r AS (SELECT user_id, t, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, value FROM e),
l AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS t, 0::BIGINT AS event_id, 0.0::DOUBLE AS y FROM (SELECT DISTINCT user_id FROM r)
UNION ALL SELECT r.user_id, r.i, r.t, r.event_id, 0.9 * l.y + 0.1 * r.value FROM l JOIN r ON r.user_id = l.user_id AND r.i = l.i + 1)
SELECT user_id, t, event_id, round(y, 6) AS smoothed FROM l WHERE i > 0""")
def smoothed_series(spark, d):
    step = windows.affine(F.lit(0.9), 0.1 * F.col("value"))
    made = windows.level_series(_events(spark, d), ["user_id"], ["t", "event_id"], F.floor(F.col("t") / 86_400), step, windows.affines(), 0.0, name="smoothed")
    return made.withColumn("smoothed", F.round("smoothed", 6))


@_query(f"""WITH RECURSIVE {_E}, r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, value FROM e),
l AS (SELECT user_id, 0::BIGINT AS i, 0.0::DOUBLE AS y FROM (SELECT DISTINCT user_id FROM r)
UNION ALL SELECT r.user_id, r.i, 0.9 * l.y + 0.1 * r.value FROM l JOIN r ON r.user_id = l.user_id AND r.i = l.i + 1)
SELECT user_id, round(arg_max(y, i), 6) AS smoothed FROM l GROUP BY user_id""")
def smoothed_signal(spark, d):
    return windows.smoothed(_events(spark, d), ["user_id"], ["t", "event_id"], "value", 0.1, F.floor(F.col("t") / 86_400)).withColumn("smoothed", F.round("smoothed", 6))


# Anchors are error events of high value; each rules the seconds around it.
_A = f"{_E}, a AS (SELECT event_id AS anchor_id, user_id AS anchor_user, t AS at_s FROM e WHERE event_type = 'error' AND value >= 60)"


def _anchors(spark, d) -> DataFrame:
    rows = _events(spark, d).filter("event_type = 'error' and value >= 60")
    return rows.select(F.col("event_id").alias("anchor_id"), F.col("user_id").alias("anchor_user"), F.col("t").alias("at_s"))


def _context(spark, d) -> DataFrame:
    last = _events(spark, d).agg(F.max("t")).first()[0] or 0
    return intervals.context_windows(_anchors(spark, d), "at_s", 1200, 3000, last)


_C = f"{_A}, c AS (SELECT *, greatest(0, at_s - 1200) AS window_start_s, least((SELECT max(t) FROM e), at_s + 3000) AS window_end_s FROM a)"


@_query(f"""WITH {_C} SELECT anchor_id, window_start_s, window_end_s, count(*) AS n, count(*) FILTER (t < at_s) AS before, count(*) FILTER (event_type = 'purchase') AS purchases, round(avg(value), 6) AS mean
FROM c JOIN e ON t BETWEEN window_start_s AND window_end_s GROUP BY ALL""")
def interval_context_windows(spark, d):
    rows = intervals.inside(_events(spark, d), "t", _context(spark, d), Interval("window_start_s", "window_end_s", True), 3600)
    return rows.groupBy("anchor_id", "window_start_s", "window_end_s").agg(
        F.count("*").alias("n"), F.count_if(F.col("t") < F.col("at_s")).alias("before"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.round(F.avg("value"), 6).alias("mean"))


def _overlaps(spark, d, keep: str) -> DataFrame:
    spans = _context(spark, d).withColumns({"label_a": (F.col("anchor_id") % 2).cast("int"), "label_b": (F.col("anchor_user") % 3 == 0).cast("int")})
    return intervals.overlap_labels(spans, Interval("window_start_s", "window_end_s", True), "anchor_id", "at_s", ["label_a", "label_b"], 60, keep)


_O = f"{_C}, x AS (SELECT c.*, anchor_id % 2 AS label_a, CASE WHEN anchor_user % 3 = 0 THEN 1 ELSE 0 END AS label_b, 60 * unnest(range(CAST(ceil(window_start_s / 60.0) AS BIGINT), window_end_s // 60 + 1)) AS time_s FROM c)"


def _overlap_sql(keep: str) -> str:
    pick = "arg_min" if keep == "first" else "arg_max"
    return f"""WITH {_O} SELECT time_s, count(*) AS active, CASE WHEN count(*) > 1 THEN 'MULTIPLE' ELSE any_value(anchor_id)::VARCHAR END AS scenario_id,
{pick}(anchor_id, at_s * 1000000000 + anchor_id) AS {keep}_id, string_agg(anchor_id::VARCHAR, '|' ORDER BY at_s, anchor_id::VARCHAR) AS active_ids,
max(label_a)::INT AS label_a, max(label_b)::INT AS label_b FROM x GROUP BY time_s"""


@_query(_overlap_sql("first"))
def interval_overlap_labels(spark, d):
    return _overlaps(spark, d, "first")


@_query(_overlap_sql("last"))
def interval_overlap_last(spark, d):
    return _overlaps(spark, d, "last")


@_query(f"""WITH {_O}, g AS (SELECT time_s, count(*) AS active FROM x GROUP BY time_s), s AS (SELECT unnest(range(0, (SELECT max(t) + 1 FROM e), 60)) AS time_s)
SELECT s.time_s, coalesce(active, 0) AS active, CASE WHEN active IS NULL THEN 'BACKGROUND' WHEN active > 1 THEN 'OVERLAP_MULTIPLE' ELSE 'SCENARIO_ACTIVE' END AS alignment_status FROM s LEFT JOIN g USING (time_s)""")
def aligned_spine(spark, d):
    end = (_events(spark, d).agg(F.max("t")).first()[0] or -1) + 1
    spine = spark.range(0, end, 60).withColumnRenamed("id", "time_s")
    return intervals.align(spine, _overlaps(spark, d, "last")).select("time_s", "active", "alignment_status")


_KINDS = ("click", "error", "purchase", "signup", "view")


@_query(f"""WITH {_E}, s AS (SELECT unnest(range(0, (SELECT max(t) + 1 FROM e), 60)) AS time_s), p AS (SELECT t // 60 * 60 AS time_s, {', '.join(f"max(CASE WHEN event_type = '{k}' THEN 1 ELSE 0 END) AS {k}" for k in _KINDS)} FROM e GROUP BY 1)
SELECT s.time_s, {', '.join(f'coalesce({k}, 0) AS {k}' for k in _KINDS)} FROM s LEFT JOIN p USING (time_s)""")
def point_stamping(spark, d):
    events = _events(spark, d)
    end = (events.agg(F.max("t")).first()[0] or -1) + 1
    return intervals.stamp(spark.range(0, end, 60).withColumnRenamed("id", "time_s"), events, "t", {k: F.col("event_type") == k for k in _KINDS}, 60)


@_query(f"""WITH {_C}, d AS (SELECT k AS detection_id, k * 3600 AS s, k * 3600 + 7199 AS f FROM (SELECT unnest(range(0, (max(t) + 1 - 7200) // 3600 + 1)) AS k FROM e))
SELECT detection_id, anchor_id, least(f, window_end_s) - greatest(s, window_start_s) + 1 AS shared_s FROM d JOIN c ON s <= window_end_s AND f >= window_start_s""")
def detection_overlap_seconds(spark, d):
    # a detection for each full window of the events
    end = (_events(spark, d).agg(F.max("t")).first()[0] or -1) + 1
    hits = spark.range(max(0, (end - 7200) // 3600 + 1)).select(F.col("id").alias("detection_id"), (F.col("id") * 3600).alias("s"), (F.col("id") * 3600 + 7199).alias("f"))
    left = hits.withColumn("b", F.explode(F.sequence(F.floor(F.col("s") / 3600), F.floor(F.col("f") / 3600))))
    right = _context(spark, d).withColumn("b", F.explode(F.sequence(F.floor(F.col("window_start_s") / 3600), F.floor(F.col("window_end_s") / 3600))))
    shared = intervals.overlap_seconds(F.col("s"), F.col("f"), F.col("window_start_s"), F.col("window_end_s"))
    return left.join(right, "b").select("detection_id", "anchor_id", shared.alias("shared_s")).filter("shared_s > 0").distinct()


@_query(f"""WITH {_A}, b AS (SELECT *, max(at_s + 599) OVER (ORDER BY at_s, anchor_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM a) SELECT anchor_id, at_s FROM b WHERE p IS NULL OR p < at_s""")
def non_overlapping(spark, d):
    spans = _anchors(spark, d).withColumn("end_s", F.col("at_s") + 600)
    return intervals.non_overlapping(spans, Interval("at_s", "end_s"), "anchor_id").select("anchor_id", "at_s")


@_query(f"WITH {_E} SELECT user_id, {', '.join(f"min(CASE WHEN event_type = '{k}' THEN t END) AS {k}_time" for k in _KINDS)} FROM e GROUP BY user_id")
def lifecycle_pivot(spark, d):
    return lifecycle.stage_times(_events(spark, d), "user_id", "event_type", "t", list(_KINDS))


_KIND_OF = {"click": "normal", "view": "delayed", "error": "blocked", "purchase": "replay", "signup": "wrong_setpoint"}
_GAPS = [1, 2, 1, 5, 3]
#: The stages as SQL states them, apart from the operator's own table.
_STAGES_SQL = """WHEN 'normal' THEN ['DER_CONTROL_CREATED', 'DER_CONTROL_SENT', 'DER_CONTROL_RECEIVED', 'DER_CONTROL_ACCEPTED', 'DER_CONTROL_APPLIED', 'DER_CONTROL_RESPONSE']
WHEN 'delayed' THEN ['DER_CONTROL_CREATED', 'DER_CONTROL_SENT', 'DER_CONTROL_RECEIVED', 'DER_CONTROL_ACCEPTED', 'DER_CONTROL_APPLIED', 'DER_CONTROL_RESPONSE']
WHEN 'blocked' THEN ['DER_CONTROL_CREATED', 'DER_CONTROL_SENT', 'SECURITY_AUTH_FAILURE', 'SECURITY_BLOCKED_COMMAND'] WHEN 'replay' THEN ['DER_CONTROL_CREATED', 'DER_CONTROL_SENT', 'SECURITY_REPLAY_DETECTED', 'DER_CONTROL_REJECTED']
WHEN 'wrong_setpoint' THEN ['DER_CONTROL_CREATED', 'DER_CONTROL_SENT', 'DER_CONTROL_RECEIVED', 'SECURITY_INTEGRITY_MISMATCH', 'DER_CONTROL_APPLIED', 'DER_CONTROL_RESPONSE']"""


@_query(f"""WITH {_E}, k AS (SELECT event_id, t, CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _KIND_OF.items())} END AS kind FROM e),
s AS (SELECT *, CASE kind {_STAGES_SQL} END AS st FROM k), x AS (SELECT event_id, kind, st, t, unnest(range(0, len(st))) AS lifecycle_order FROM s)
SELECT event_id, kind, lifecycle_order::INT AS lifecycle_order, st[lifecycle_order + 1] AS lifecycle_stage, t + [0, 1, 3, 4, 9, 12][least(lifecycle_order, 5) + 1] AS stage_time_s,
CASE WHEN kind = 'blocked' THEN 'failed' ELSE 'passed' END AS authz_status, CASE WHEN kind = 'wrong_setpoint' THEN 'compromised' ELSE 'passed' END AS integrity_status, CASE WHEN kind = 'delayed' THEN 'degraded' ELSE 'normal' END AS availability_status,
CASE WHEN kind = 'blocked' THEN 'blocked' WHEN kind = 'delayed' THEN 'delayed' ELSE 'delivered' END AS delivery_status, CASE kind WHEN 'blocked' THEN 'blocked' WHEN 'replay' THEN 'replay_detected' WHEN 'wrong_setpoint' THEN 'integrity_mismatch' ELSE 'success' END AS comm_outcome FROM x""")
def lifecycle_expand(spark, d):
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _KIND_OF.items() for x in kv]), F.col("event_type"))
    rows = lifecycle.expand(_events(spark, d).select("event_id", "t", kind.alias("kind")), "kind", "t", _GAPS)
    status = lifecycle.statuses(F.col("kind"))
    return rows.select("event_id", "kind", "lifecycle_order", "lifecycle_stage", F.col("stage_time_s").cast("long").alias("stage_time_s"), *[c.alias(n) for n, c in status.items()])


@_query(f"WITH {_A}, x AS (SELECT anchor_id, at_s, unnest(range(0, 5 + anchor_id % 6)) AS b FROM a) SELECT anchor_id::VARCHAR || '_burst' || b AS anchor_id, b::INT AS burst, at_s + 3 * b AS at_s FROM x")
def burst_expand(spark, d):
    rows = lifecycle.burst(_anchors(spark, d), "anchor_id", "at_s", (5 + F.col("anchor_id") % 6).cast("int"), 3)
    return rows.select("anchor_id", "burst", F.col("at_s").cast("long").alias("at_s"))


@_query(f"WITH {_E}, r AS (SELECT user_id, event_id, lag(event_id, 5) OVER (PARTITION BY user_id ORDER BY t, event_id) AS earlier_id FROM e) SELECT * FROM r WHERE earlier_id IS NOT NULL")
def replay_lookback(spark, d):
    return windows.shifted(_events(spark, d), ["user_id"], ["t", "event_id"], "event_id", 5, "earlier_id").select("user_id", "event_id", "earlier_id").filter("earlier_id is not null")


@_query(f"WITH {_E} SELECT event_type, least(19, floor(value / 25))::BIGINT AS bin, count(*) AS n FROM e WHERE value BETWEEN 0 AND 500 GROUP BY ALL")
def value_histogram(spark, d):
    return explain.histogram(_events(spark, d), "value", 0, 500, 20, ["event_type"])


@_query(f"""WITH {_E} SELECT event_id, t // 86400 AS day, t % 86400 AS second_of_day, strftime(TIMESTAMP '2024-01-01' + to_seconds(t), '%Y-%m-%dT%H:%M:%SZ') AS stamp,
'e' || lpad(event_id::VARCHAR, 7, '0') AS name, (t // 300) % 2 AS phase FROM e""")
def time_columns(spark, d):
    rows = _events(spark, d)
    return rows.select("event_id", F.floor(F.col("t") / 86400).alias("day"), (F.col("t") % 86400).alias("second_of_day"), iso(F.col("t"), BASE).alias("stamp"),
                       F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 7, "0")).alias("name"), windows.phase(F.col("t"), F.lit(0), 300).alias("phase"))


@_query(f"WITH {_E} SELECT event_type, user_id % 3 AS g, count(*) AS n, min(t) AS first_t, max(t) AS last_t, round(avg((value > 50)::INT), 6) AS share FROM e GROUP BY ALL")
def flag_fractions(spark, d):
    rows = _events(spark, d)
    return rows.groupBy("event_type", (F.col("user_id") % 3).alias("g")).agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("share"))


@_query(f"""WITH {_C}, r AS (SELECT c.anchor_id, e.* FROM c JOIN e ON t BETWEEN window_start_s AND window_end_s),
l AS (SELECT anchor_id, t, event_id, u.signal, u.v FROM r, LATERAL (VALUES ('amount', value), ('k', CAST(json_extract_string(props, '$.k') AS DOUBLE)), ('user', CAST(user_id AS DOUBLE))) u(signal, v)),
g AS (SELECT anchor_id, signal, count(*) AS points, round(stddev_samp(v), 6) AS std, round(max(v) - min(v), 6) AS spread FROM l GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY std DESC NULLS LAST, signal) AS rank FROM g) SELECT * FROM k WHERE rank <= 2""")
def topk_signals(spark, d):
    rows = _events(spark, d).select("t", "event_id", F.col("value").alias("amount"), F.get_json_object("props", "$.k").cast("double").alias("k"), F.col("user_id").cast("double").alias("user"))
    met = intervals.inside(rows, "t", _context(spark, d), Interval("window_start_s", "window_end_s", True), 3600)
    # summed wide and turned afterwards: the joined rows are not copied for each signal
    each = lambda v: F.struct(F.count("*").alias("points"), F.round(F.stddev_samp(v), 6).alias("std"), F.round(F.max(v) - F.min(v), 6).alias("spread")).alias(v)
    made = met.groupBy("anchor_id").agg(*[each(v) for v in ("amount", "k", "user")]).unpivot(["anchor_id"], ["amount", "k", "user"], "signal", "v").select("anchor_id", "signal", "v.*")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc_nulls_last("std"), "signal"))
    return made.withColumn("rank", rank.cast("long")).filter("rank <= 2")


@_query(f"WITH {_W} SELECT window_id, row_number() OVER (PARTITION BY window_id ORDER BY t, event_id) - 1 AS step, value FROM w")
def sequence_windows(spark, d):
    made = windows.tensor(_events(spark, d), "t", "event_id", "value", WIDTH, STRIDE)
    return made.select("window_id", F.posexplode("steps").alias("step", "value")).withColumn("step", F.col("step").cast("long"))


@_query(f"""WITH {_E}, a AS (SELECT event_type, user_id, max(value) AS top FROM e GROUP BY ALL), x AS (SELECT * FROM a WHERE event_type = 'error' ORDER BY top DESC, user_id LIMIT 1),
y AS (SELECT * FROM a WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM x) ORDER BY top DESC, user_id LIMIT 1) SELECT event_type, user_id, top FROM x UNION ALL SELECT event_type, user_id, top FROM y""")
def presenter_choice(spark, d):
    tops = _events(spark, d).groupBy("event_type", "user_id").agg(F.max("value").alias("top"))
    return windows.best_of_each(tops, "event_type", "user_id", [F.desc("top")], ["error", "purchase"])


@_query(f"""WITH {_E}, h AS (SELECT user_id, t // 86400 AS day, t, value FROM e), l AS (SELECT user_id, day, t, max(value) AS value FROM h GROUP BY ALL)
SELECT event_id, p.user_id, p.t, l.value AS earlier FROM (SELECT event_id, user_id, t // 86400 AS day, t, t - 7200 AS at FROM e) p ASOF LEFT JOIN l ON l.user_id = p.user_id AND l.day = p.day AND l.t <= p.at""")
def delayed_values(spark, d):
    """What each user's signal was two hours before, inside the same day: a shift by time, not by rows."""
    rows = _events(spark, d).withColumn("day", F.floor(F.col("t") / 86_400))
    points = rows.select("event_id", "user_id", "day", F.col("t").alias("now"), (F.col("t") - 7200).alias("t"))
    made = intervals.as_of(points, rows.select("user_id", "day", "t", F.col("value").alias("earlier")), "t", ["earlier"], ["user_id", "day"], 21_600)
    return made.select("event_id", "user_id", F.col("now").alias("t"), "earlier")
