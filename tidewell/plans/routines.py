"""Routines, latencies, meter rows, evidence matrices, slices and records for charts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bundles, explain, intervals, lifecycle, quality, scenarios, telemetry, windows
from ..operators.intervals import Interval
from ..sources import readers, sinks
from ..sources.readers import table
from .ingest import _ROWS, _read
from .site import _KINDS, _SC, _scenarios
from .timeseries import _E, _events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


_PARTS = (("network", 50.0, 15.0, 5.0, 8000.0, 2000.0, 100.0), ("processing", 20.0, 5.0, 5.0, 40.0, 20.0, 10.0), ("queue", 5.0, 2.0, 0.5, 500.0, 100.0, 50.0))


def _drawn(seed: int) -> str:
    part = lambda at: f"(('0x' || substr(md5('{seed}:' || k), {at}, 8))::BIGINT::DOUBLE + 1) / 4294967297.0::DOUBLE"
    return f"sqrt(-2 * ln({part(1)})) * cos(2 * pi() * {part(9)})"


@_query(f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 = 0 AS slow FROM orders), x AS (SELECT k, slow, {', '.join(f"CASE WHEN slow THEN {m2} + {s2} * ({_drawn(300 + i)}) ELSE {m} + {s} * ({_drawn(200 + i)}) END AS x{i}" for i, (_, m, s, _, m2, s2, _) in enumerate(_PARTS))} FROM o)
SELECT k, {', '.join(f"round(greatest(x{i}, CASE WHEN slow THEN {f2} ELSE {f} END), 6) AS {name}_latency_ms" for i, (name, _, _, f, _, _, f2) in enumerate(_PARTS))}, round(CASE WHEN slow THEN 10.0 ELSE 0.0 END + (x0 + x1 + x2) / 1000, 6) AS total_delay_s FROM x""")
def command_latencies(spark, d):
    """Network, processing and queue times of every order as a command, one in five of them delayed."""
    k = F.col("o_orderkey")
    made = lifecycle.latencies(k, k % 5 == 0)
    return table(spark, d, "orders").select(k.alias("k"), *[F.round(x, 6).alias(n) for n, x in made.items()])


@_query(f"""WITH {_E}, d AS (SELECT DISTINCT t // 86400 AS day FROM e), r(routine, sec) AS ({' UNION ALL '.join(f"SELECT '{name}', unnest({at})" for name, at in lifecycle.ROUTINES.items())}) SELECT day, routine, (day * 86400 + sec)::BIGINT AS time_s FROM d, r""")
def routine_schedule(spark, d):
    """Commands, storage, meters and status reports of every day of the log."""
    days = _events(spark, d).select(F.floor(F.col("t") / 86_400).alias("day")).distinct()
    return lifecycle.routines(days, "day").select("day", "routine", "time_s")


_ID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"


@_query(f"""WITH {_E}, m AS (SELECT 'pcc_' || user_id AS asset_id, t AS time_s, value AS p, value / 4 AS q, 'metering_background' AS scenario_id, 0 AS label FROM e WHERE event_type = 'view' UNION ALL
SELECT 'pcc_001', s_suppkey::BIGINT * 6047 % 600000, s_acctbal, 0.0, 'S' || s_suppkey, 1 FROM supplier), x AS (SELECT *, md5(asset_id || ':' || time_s) AS h FROM m)
SELECT {_ID} AS message_mrid, asset_id, time_s, scenario_id, round(p, 6) AS applied_p_kw, round(q, 6) AS applied_q_kvar, time_s * 1000 + 90 AS command_response_time_ms, label AS label_anomaly, 0.045::DOUBLE AS total_delay_s, 'delivered' AS delivery_status FROM x""")
def meter_rows(spark, d):
    """A meter reading for each view, and one a scenario with the labels of the scenario."""
    views = _events(spark, d).filter("event_type = 'view'").select(F.concat(F.lit("pcc_"), F.col("user_id").cast("string")).alias("a"), "t", F.col("value").alias("p"), (F.col("value") / 4).alias("q"))
    k = F.col("s_suppkey").cast("long")
    marked = table(spark, d, "supplier").select(F.lit("pcc_001").alias("a"), (k * 6047 % 600_000).alias("t"), F.col("s_acctbal").alias("p"), F.lit(0.0).alias("q"), F.concat(F.lit("S"), k.cast("string")).alias("sid"))
    made = lifecycle.meter_readings(views, "a", "t", "p", "q").unionByName(lifecycle.meter_readings(marked, "a", "t", "p", "q", {"scenario_id": F.col("sid"), "label_anomaly": F.lit(1)}))
    return made.select("message_mrid", "asset_id", "time_s", "scenario_id", F.round("applied_p_kw", 6).alias("applied_p_kw"), F.round("applied_q_kvar", 6).alias("applied_q_kvar"), "command_response_time_ms", "label_anomaly", "total_delay_s", "delivery_status")


@_query(f"""WITH {_ROWS}, v AS (SELECT * FROM s WHERE g NOT IN (0, 7)) SELECT b AS bundle_id, i::INT AS place, CASE WHEN n > 0 THEN 60 ELSE 0 END AS ramp_s, CASE WHEN contains(coalesce(family, ''), 'delay') THEN greatest(30, CASE WHEN n > 0 THEN 60 ELSE CASE WHEN f = 8 THEN 5 WHEN f = 9 THEN 150 ELSE 75 END END) ELSE 0 END AS delay_s FROM v""")
def bundle_delays(spark, d):
    """The longest ramp of each scenario's effects, and the delay that follows for families of delays."""
    rows = bundles.scenarios(_read(spark, d))
    delay = scenarios.delay_seconds(F.coalesce("scenario_family", F.lit("")), F.col("physical_effects"), F.col("duration_s"))
    return rows.select("bundle_id", "place", scenarios.ramp_seconds(F.col("physical_effects")).cast("int").alias("ramp_s"), delay.cast("int").alias("delay_s"))


@_query(f"""WITH {_E}, d AS (SELECT unnest(range(0, max(t) // 86400 + 1)) AS k FROM e), r AS (SELECT k AS detection_id, value AS amount, (t % 3600)::DOUBLE AS phase, (event_type = 'error')::INT AS bad, event_id, t FROM d JOIN e ON t BETWEEN k * 86400 AND k * 86400 + 7199),
g AS (SELECT detection_id, 'amount' AS signal, stddev_samp(amount) AS std, arg_max(amount, t) - arg_min(amount, t) AS delta FROM r GROUP BY 1 UNION ALL SELECT detection_id, 'phase', stddev_samp(phase), arg_max(phase, t) - arg_min(phase, t) FROM r GROUP BY 1),
f AS (SELECT detection_id, round(avg(bad), 4) AS active_fraction FROM r GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY detection_id ORDER BY std DESC NULLS LAST, signal) AS rank FROM g)
SELECT detection_id, rank::INT AS rank, signal, round(std, 6) AS std, CASE WHEN delta > 0.01 THEN 'increase' WHEN delta < -0.01 THEN 'decrease' ELSE 'stable' END AS direction, active_fraction FROM k JOIN f USING (detection_id)""")
def signal_directions(spark, d):
    """Signals of the first two hours of each day, most variable first, with their direction and the share of the window that is active."""
    rows = _events(spark, d).select("event_id", F.col("t").alias("time_s"), F.col("value").alias("amount"), (F.col("t") % 3600).cast("double").alias("phase"), (F.col("event_type") == "error").cast("int").alias("bad"))
    days = (rows.agg(F.max("time_s")).first()[0] or 0) // 86_400 + 1
    hits = spark.range(days).select(F.col("id").alias("detection_id"), (F.col("id") * 86_400).alias("window_start_s"), (F.col("id") * 86_400 + 7199).alias("window_end_s"))
    made = explain.signal_evidence(hits, rows, ["amount", "phase"], 7200, order="event_id")
    active = intervals.inside(rows, "time_s", hits, Interval("window_start_s", "window_end_s", True), 7200).groupBy("detection_id").agg(F.round(F.avg("bad"), 4).alias("active_fraction"))
    return made.join(active, "detection_id").select("detection_id", "rank", "signal", F.round("std", 6).alias("std"), "direction", "active_fraction")


@_query(f"""WITH {_SC}, s AS (SELECT scenario_class, (scenario_id % 7 <> 0 OR scenario_class = 'normal')::INT AS a, (scenario_id % 5 <> 0)::INT AS b, (scenario_id % 13 = 0)::INT AS p, scenario_id % 11 <> 0 AND scenario_class <> 'cyber_only' AS ok FROM sd),
o AS (SELECT *, CASE WHEN ok THEN greatest(0, least(1, (a + b) / 2 - 0.15 * p)) ELSE 0 END AS score FROM s)
SELECT scenario_class, count(*) AS n, round(avg(a), 6) AS class_match, round(avg(b), 6) AS asset_match, round(avg(p), 6) AS unsupported, round(avg(ok::INT), 6) AS parse_rate, round(avg(score) FILTER (ok), 6) AS mean_score FROM o GROUP BY 1""")
def evidence_matrix(spark, d):
    """Means of checks, penalties and scores of explanations by class; a class of which none parsed has no score."""
    k, kind = F.col("scenario_id"), F.col("scenario_class")
    rows = _scenarios(spark, d).select("scenario_class", ((k % 7 != 0) | (kind == "normal")).cast("int").alias("class_match"), (k % 5 != 0).cast("int").alias("asset_match"), (k % 13 == 0).cast("int").alias("unsupported"), ((k % 11 != 0) & (kind != "cyber_only")).alias("parsed"))
    return explain.score_matrix(rows, ["scenario_class"], ["class_match", "asset_match"], ["unsupported"], "parsed")


@_query(f"""WITH {_E}, c AS (SELECT event_type, user_id, max(value) AS top, max(value) - min(value) AS dp, max(t % 3600) - min(t % 3600) AS db FROM e GROUP BY ALL), k AS (SELECT *, round(top + 0.01 * greatest(dp, db), 6) AS key FROM c),
a AS (SELECT * FROM k WHERE event_type = 'click' ORDER BY key DESC, user_id LIMIT 1), b AS (SELECT * FROM k WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM a) ORDER BY key DESC, user_id LIMIT 1),
x AS (SELECT * FROM k WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM a UNION ALL SELECT user_id FROM b) ORDER BY key DESC, user_id LIMIT 1) SELECT event_type, user_id, key FROM a UNION ALL SELECT event_type, user_id, key FROM b UNION ALL SELECT event_type, user_id, key FROM x""")
def presenter_composite(spark, d):
    """The best case of each class by its score and a hundredth of its widest swing; no case stands for two classes."""
    phase = F.col("t") % 3600
    cases = _events(spark, d).groupBy("event_type", "user_id").agg(F.max("value").alias("top"), (F.max("value") - F.min("value")).alias("dp"), (F.max(phase) - F.min(phase)).alias("db"))
    keyed = cases.select("event_type", "user_id", F.round(F.col("top") + 0.01 * F.greatest("dp", "db"), 6).alias("key"))
    return windows.best_of_each(keyed, "event_type", "user_id", [F.desc("key")], ["click", "error", "view"])


_SLICED = "sp AS (SELECT s_suppkey::BIGINT AS id, s_suppkey::BIGINT * 6047 % 600000 AS s, s_suppkey::BIGINT * 6047 % 600000 + 599 + s_suppkey * 37 % 1200 AS x, " + str(list(_KINDS)) + "[s_suppkey % 4 + 1] AS kind FROM supplier), f AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY kind ORDER BY id) = 1)"


def _first_of_kind(spark, d) -> DataFrame:
    k = F.col("s_suppkey").cast("long")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k % 4 + 1).cast("int"))
    spans = table(spark, d, "supplier").select(k.alias("id"), (k * 6047 % 600_000).alias("s"), (k * 6047 % 600_000 + 599 + k * 37 % 1200).alias("x"), kind.alias("kind"))
    return windows.best_per_group(spans, ["kind"], F.col("id"))


@_query(f"""WITH {_E}, {_SLICED} SELECT kind, id, event_id, t - s AS since, (t BETWEEN s AND x) AS inside, value FROM f JOIN e ON t BETWEEN s - 120 AND x + 120""")
def example_slices(spark, d):
    """The signal around the first scenario of each kind, two minutes before and after."""
    spans = _first_of_kind(spark, d).withColumns({"lo": F.col("s") - 120, "hi": F.col("x") + 120})
    met = intervals.inside(_events(spark, d).select("event_id", "t", "value"), "t", spans, Interval("lo", "hi", True), 3600)
    return met.select("kind", "id", "event_id", (F.col("t") - F.col("s")).alias("since"), F.col("t").between(F.col("s"), F.col("x")).alias("inside"), "value")


@_query(f"""WITH {_E}, h AS (SELECT event_type AS component, t // 21600 AS block, round(avg(value), 6) AS mean, count(*) AS n FROM e GROUP BY ALL) SELECT component, block, mean, n, row_number() OVER (PARTITION BY component ORDER BY block) - 1 AS point FROM h""")
def viewer_records(spark, d):
    """Each component's series as one record of parallel arrays, as a viewer reads it, and the chart rows out of the record."""
    rows = _events(spark, d).groupBy(F.col("event_type").alias("component"), F.floor(F.col("t") / 21_600).alias("block")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
    records = explain.series(rows, ["component"], "block", ["mean", "n"])
    return records.select("component", F.posexplode(F.arrays_zip("block", "mean", "n")).alias("point", "z")).select("component", "z.block", "z.mean", "z.n", F.col("point").cast("long").alias("point"))


@_query("""WITH m AS (SELECT o_custkey % 7 AS site, CASE WHEN o_custkey % 7 = 0 THEN 'resolved' WHEN o_custkey % 7 = 1 THEN 'surrogate' WHEN o_orderkey % 9 = 0 AND o_custkey % 7 = 3 THEN 'guess ' || o_orderkey % 4 WHEN o_orderkey % 2 = 0 THEN 'resolved' ELSE 'surrogate' END AS method FROM orders),
g AS (SELECT site, count(*) FILTER (method = 'resolved') AS resolved_rows, count(*) FILTER (method = 'surrogate') AS surrogate_rows, count(DISTINCT method) FILTER (method NOT IN ('resolved', 'surrogate')) AS unknown_methods FROM m GROUP BY 1)
SELECT *, CASE WHEN resolved_rows > 0 AND surrogate_rows = 0 THEN 'C' WHEN resolved_rows > 0 THEN 'B' ELSE 'A' END AS claim_case, CASE WHEN unknown_methods > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM g""")
def claim_cases(spark, d):
    """What may be claimed of each site's rows, by how many of them were resolved."""
    c, k = F.col("o_custkey") % 7, F.col("o_orderkey")
    method = F.when(c == 0, "resolved").when(c == 1, "surrogate").when((k % 9 == 0) & (c == 3), F.concat(F.lit("guess "), (k % 4).cast("string"))).when(k % 2 == 0, "resolved").otherwise("surrogate")
    rows = table(spark, d, "orders").select(c.alias("site"), method.alias("method"))
    return quality.claim_case(rows, ["site"], "method", "resolved", "surrogate", ["resolved", "surrogate"])


@_query("""WITH x AS (SELECT s_suppkey::VARCHAR AS name, CASE WHEN s_suppkey % 5 <> 0 THEN length(s_name) + 1 END AS n, 11 + s_suppkey % 3 AS least, s_suppkey % 2 = 0 AS soft FROM supplier)
SELECT name, n IS NOT NULL AS exists, coalesce(n, 0)::BIGINT AS length, CASE WHEN n >= least THEN 'PASS' WHEN soft THEN 'WARN' ELSE 'FAIL' END AS status FROM x""")
def expected_files(spark, d):
    """A file a supplier is expected: some are absent, some too short, and of those some only warn."""
    path, rows, k = sinks.scratch(spark, "expected"), table(spark, d, "supplier"), F.col("s_suppkey")
    sinks.write_text_files(rows.filter(k % 5 != 0).select((k % 8).alias("folder"), k.cast("string").alias("name"), F.col("s_name").alias("value")), path)
    found = readers.files(spark, path, [".txt"]).select(F.regexp_extract("path", "name=([0-9]+)", 1).alias("name"), "length")
    expected = rows.select(k.cast("string").alias("name"), (11 + k % 3).alias("least"), (k % 2 == 0).alias("soft"))
    return quality.file_checks(found, expected)


@_query(f"""WITH {_E}, v AS (SELECT user_id, floor(value) AS value FROM e), w AS (SELECT user_id, max(abs(value)) AS p, round(avg(value), 3) AS a FROM v GROUP BY 1), k AS (SELECT *, {list(_KINDS)}[user_id % 4 + 1] AS kind FROM w)
SELECT user_id AS scenario_id, kind AS scenario_class, CASE kind WHEN 'normal' THEN 'baseline behaviour' WHEN 'cyber_only' THEN 'event log without physical change' WHEN 'physical_only' THEN 'physical change without command' ELSE 'command and physical change together' END AS focus,
'active from ' || user_id * 100 || ' s to ' || user_id * 100 + 299 || ' s' AS timing, CASE WHEN p <= 110 THEN 'pass' ELSE 'fail' END AS power_status, round(a, 2) AS actual_p FROM k""")
def context_packets(spark, d):
    """A nested document a scenario - its class, timing, constraint checks and physical evidence - read back out of the JSON."""
    v = F.floor("value").cast("double")
    columns = {f"{k}_{s}": x for s in ("p_kw", "q_kvar", "voltage_pu", "soc_percent") for k, x in (("baseline", v - 1), ("actual", v), ("residual", F.lit(1.0)))}
    rows = _events(spark, d).select(F.col("user_id").alias("scenario_id"), *[x.alias(n) for n, x in columns.items()])
    k = F.col("scenario_id")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k % 4 + 1).cast("int"))
    about = rows.select("scenario_id").distinct().select("scenario_id", kind.alias("scenario_class"), F.lit("x").alias("scenario_family"), (k * 100).cast("long").alias("start_time_s"), F.lit(300).cast("long").alias("duration_s"))
    made = scenarios.packets(about, scenarios.constraint_checks(rows), scenarios.physical_evidence(rows))
    get = lambda path: F.get_json_object("packet", path)
    return made.select("scenario_id", get("$.scenario_class").alias("scenario_class"), get("$.focus").alias("focus"), get("$.timing").alias("timing"), get("$.constraint_checks[0].status").alias("power_status"), F.round(get("$.physical_evidence[0].actual").cast("double"), 2).alias("actual_p"))


@_query(f"""WITH {_E}, h AS (SELECT t // 7200 AS block, 1 + (avg(value) FILTER (event_type = 'view') - 50) / 1000 AS a, 1 + (avg(value) FILTER (event_type = 'click') - 50) / 1000 AS b, 1 + (avg(value) FILTER (event_type = 'error') - 50) / 1000 AS c FROM e GROUP BY 1), m AS (SELECT *, (a + b + c) / 3 AS mean FROM h WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
s AS (SELECT *, greatest(abs(a - mean), abs(b - mean), abs(c - mean)) AS spread FROM m) SELECT block, round(spread, 9) AS unbalance, CASE WHEN spread >= 0.03 THEN 'critical' WHEN spread >= 0.02 THEN 'warning' WHEN spread >= 0.012 THEN 'caution' ELSE 'normal' END AS level FROM s""")
def unbalance_levels(spark, d):
    """How far three phases lie apart in each block of two hours, and the level of it."""
    phase = lambda kind: 1 + (F.avg(F.when(F.col("event_type") == kind, F.col("value"))) - 50) / 1000
    made = _events(spark, d).groupBy(F.floor(F.col("t") / 7200).alias("block")).agg(*[phase(k).alias(f"pcc_v_{p}_pu") for p, k in (("a", "view"), ("b", "click"), ("c", "error"))]).dropna()
    return telemetry.with_voltages(made).select("block", F.round("pcc_voltage_unbalance_pu", 9).alias("unbalance"), F.col("voltage_unbalance_status").alias("level"))


@_query(f"""WITH {_E}, s AS (SELECT user_id, t AS sent, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS effect FROM e) SELECT least(23, (effect - sent) // 3600) AS bin, count(*) AS n, min(effect - sent) AS least_s, max(effect - sent) AS most_s FROM s WHERE effect IS NOT NULL GROUP BY 1""")
def onset_histogram(spark, d):
    """Seconds from each command to the next one of its user, in bins of an hour, the last one open."""
    from pyspark.sql import Window

    pairs = _events(spark, d).withColumn("effect", F.lead("t").over(Window.partitionBy("user_id").orderBy("t", "event_id"))).filter("effect is not null").select((F.col("effect") - F.col("t")).alias("s"))
    return pairs.groupBy(F.least(F.lit(23), F.floor(F.col("s") / 3600)).alias("bin")).agg(F.count("*").alias("n"), F.min("s").alias("least_s"), F.max("s").alias("most_s"))


@_query(f"""WITH {_E}, d AS (SELECT unnest(range(0, max(t) // 86400 + 1)) AS k FROM e), r AS (SELECT k, e.* FROM d LEFT JOIN e ON t BETWEEN k * 86400 AND k * 86400 + 1799),
g AS (SELECT k, 'amount' AS signal, stddev_samp(value) AS std FROM r WHERE event_id IS NOT NULL GROUP BY 1 UNION ALL SELECT k, 'phase', stddev_samp((t % 3600)::DOUBLE) FROM r WHERE event_id IS NOT NULL GROUP BY 1 UNION ALL SELECT k, 'user', stddev_samp(user_id::DOUBLE) FROM r WHERE event_id IS NOT NULL GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY std DESC NULLS LAST, signal) AS rank FROM g), s AS (SELECT k, string_agg(signal, ',' ORDER BY rank) AS signals FROM n WHERE rank <= 2 GROUP BY 1)
SELECT k AS detection_id, coalesce(any_value(signals), '') AS signals, concat_ws(',', CASE WHEN bool_or(event_type = 'error') THEN 'blocked_flag' END, CASE WHEN bool_or(value > 150) THEN 'mismatch_flag' END, CASE WHEN bool_or(event_type = 'purchase') THEN 'replay_flag' END) AS active_flags FROM r LEFT JOIN s USING (k) GROUP BY 1""")
def compact_evidence(spark, d):
    """The most variable signals and the flags that were up in the first half hour of each day; a window without events has neither."""
    rows = _events(spark, d).select(F.col("t").alias("time_s"), F.col("value").alias("amount"), (F.col("t") % 3600).cast("double").alias("phase"), F.col("user_id").cast("double").alias("user"), F.col("event_type").alias("cyber_state"), F.col("event_type").alias("cyber_lifecycle_stage"),
                                    (F.col("event_type") == "error").cast("int").alias("blocked_flag"), (F.col("value") > 150).cast("int").alias("mismatch_flag"), (F.col("event_type") == "purchase").cast("int").alias("replay_flag"), F.lit(1).alias("cyber_anomaly_active"))
    days = (rows.agg(F.max("time_s")).first()[0] or 0) // 86_400 + 1
    hits = spark.range(days).select(F.col("id").alias("detection_id"), (F.col("id") * 86_400).alias("window_start_s"), (F.col("id") * 86_400 + 1799).alias("window_end_s"))
    flags = ["blocked_flag", "mismatch_flag", "replay_flag"]
    made = explain.compact(explain.signal_evidence(hits, rows, ["amount", "phase", "user"], 3600), explain.cyber_evidence(hits, rows, flags, 3600), flags, 2)
    return made.select("detection_id", F.array_join("signals", ",").alias("signals"), F.array_join("active_flags", ",").alias("active_flags"))
