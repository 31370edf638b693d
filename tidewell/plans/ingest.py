"""Scenario bundles made from orders, with faults, written as JSON, read back and judged; and their SQL, from the orders alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import bundles
from ..sources import sinks
from ..sources.readers import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


_CLASSES = ["normal"] * 4 + ["cyber_only"] * 4 + ["physical_only"] * 6 + ["cyber_physical"] * 2
_BY_CLASS = ["normal_control_variation"] * 4 + ["command_delay"] * 4 + ["pcc_voltage_deviation"] * 6 + ["coordinated_pv_bess_response"] * 2
_AUTHORS = ["chatgpt", "claude", "gemini", "grok", "other"]


def _documents(spark, d: str) -> DataFrame:
    """(bundle_id, doc): sixteen orders are the scenarios of a bundle; one scenario in ten and one bundle in five has a fault."""
    # what the texts read again and again is a column of a step of its own: Java leaves a method of over 8,000 bytes of code uncompiled
    key = F.col("o_orderkey")
    orders = table(spark, d, "orders").select(key.alias("k"), F.floor(key / 16).alias("b"), (key % 16).alias("i"), (key * 7919 % 300).alias("f"))
    orders = orders.filter((F.col("b") * 31 % 40 != 4) | (F.col("i") != 15))
    k, b, i, f = (F.col(x) for x in "kbif")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))

    def field(name: str, value: Column) -> Column:
        """``"name":value``, or nothing where the value is NULL."""
        return F.concat(F.lit(f'"{name}":'), value)

    def either(cases: dict, usual: Column) -> Column:
        out = usual
        for fault, value in cases.items():
            out = F.when(f == fault, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
        return out

    ident = F.concat(F.lit("zdl_"), either({1: pick(_AUTHORS, (b + 1) % 5)}, pick(_AUTHORS, b % 5)), F.lit("_case_"), F.lpad(F.when((b * 31 % 40 == 8) & (i == 1), 0).otherwise(i).cast("string"), 3, "0"))
    physical = i >= 8
    effect = F.concat(
        F.lit('{"variable":"'), either({14: "temperature_c", 15: "x", 16: "irradiance_pu"}, F.lit("pv_p_kw")), F.lit('","effect_type":"'), either({28: "bounded_clip"}, F.lit("absolute_delta")),
        F.lit('","magnitude":'), either({17: "900.5", 27: "-0.5"}, F.lit("0.5")), F.lit(',"unit":"kW","direction":"decrease","shape":"ramp","ramp_seconds":60}'),
    )
    effects = F.when(f == 23, F.lit("{}")).when(physical != (f == 13), F.concat(F.lit("["), effect, F.lit("]"))).otherwise(F.lit("[]"))
    label = F.when(f == 12, 1).otherwise((i >= 4).cast("int")).cast("string")
    labels = F.concat(F.lit("{"), F.concat_ws(",", field("label_anomaly", label), F.when(f != 11, field("label_cyber_anomaly", label)), field("label_physical_anomaly", label)), F.lit("}"))
    context = F.concat(F.lit('{"event_level_only":'), either({18: '"yes"'}, F.lit("true")), F.lit(',"packet_level_protocol_compliance_claimed":'), either({19: "true"}, F.lit("false")), F.lit(',"cia_dimension":"'), either({20: "Malware"}, F.lit("integrity")), F.lit('"}'))
    kind, none = quoted(either({2: "unknown"}, pick(_CLASSES, i))), F.lit(None).cast("string")
    asset = quoted(either({4: "pv35", 5: "x_001"}, F.lit("pv_001")))
    parts = [
        field("scenario_id", quoted(either({0: F.concat(F.lit("case "), k.cast("string"))}, ident))), field("scenario_name", F.when(f != 29, F.lit('"n"'))), field("scenario_family", quoted(either({3: "unknown"}, pick(_BY_CLASS, i)))),
        F.when(f == 25, field("cyber_physical_type", kind)).otherwise(field("scenario_class", kind)), F.when(f == 26, field("affected_asset", asset)).otherwise(field("target_asset_id", asset)),
        field("target_component", either({6: '"unknown"', 29: none}, F.lit('"pv"'))), field("start_time_s", either({7: "-5", 9: "604700", 21: '"12"'}, (i % 7 * 86_400 + 500 * i).cast("string"))), field("duration_s", either({8: "20", 9: "600", 22: "300.5"}, F.lit("300"))),
        field("safety_note", either({10: none}, F.lit('"s"'))), field("labels", labels), field("physical_effects", effects), field("cyber_context", context),
    ]
    scenario = F.when(f == 24, F.lit('"text"')).otherwise(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    rows = orders.select("b", "i", scenario.alias("s"))
    held = rows.groupBy("b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), ",").alias("all"))
    g = b * 31 % 40
    author = F.when(g == 5, "someone").otherwise(pick(_AUTHORS, b % 5))
    said = F.when(g == 3, "something else").otherwise(bundles.COMPATIBILITY)
    top = [
        F.lit('"dataset_id":"d"'), field("author_model", quoted(author)), F.when(g != 1, field("generation_purpose", F.when(g == 6, '"other"').otherwise(f'"{bundles.PURPOSE}"'))),
        F.concat(F.when(g == 2, '"compatibility_statement":"').otherwise('"project_compatibility_statement":"'), said, F.lit('"')), field("scenarios", F.when(g == 7, F.lit('{"all":"gone"}')).otherwise(F.concat(F.lit("["), F.col("all"), F.lit("]")))),
    ]
    doc = F.concat(F.lit("{"), F.concat_ws(",", *top), F.when(g == 0, F.lit("")).otherwise(F.lit("}")))
    return held.select(b.alias("bundle_id"), doc.alias("doc"))


def _read(spark, d: str) -> DataFrame:
    """The documents through files: a line each, after its bundle's number."""
    path = sinks.scratch(spark, "bundles")
    sinks.write_text(_documents(spark, d).select(F.concat(F.col("bundle_id").cast("string"), F.lit("\t"), "doc").alias("value")), path)
    lines = spark.read.text(path)
    return bundles.parsed(lines.select(F.substring_index("value", "\t", 1).cast("long").alias("bundle_id"), F.expr("substring(value, locate('\t', value) + 1)").alias("doc")))


#: The scenarios as they read after their repair, from the orders: t is 'text', where the scenario is no object; n counts effects.
_ROWS = f"""k AS (SELECT o_orderkey::BIGINT AS k, o_orderkey // 16 AS b, o_orderkey % 16 AS i, o_orderkey::BIGINT * 7919 % 300 AS f, o_orderkey // 16 * 31 % 40 AS g FROM orders WHERE o_orderkey // 16 * 31 % 40 <> 4 OR o_orderkey % 16 <> 15),
s AS (SELECT *, CASE WHEN g = 5 THEN 'someone' ELSE {_AUTHORS}[b % 5 + 1] END AS author, CASE WHEN f = 24 THEN NULL WHEN f = 0 THEN 'case ' || k ELSE 'zdl_' || {_AUTHORS}[(b + (f = 1)::INT) % 5 + 1] || '_case_' || lpad((CASE WHEN g = 8 AND i = 1 THEN 0 ELSE i END)::VARCHAR, 3, '0') END AS sid,
CASE WHEN f = 24 THEN NULL WHEN f = 2 THEN 'unknown' ELSE {_CLASSES}[i + 1] END AS class, CASE WHEN f = 24 THEN NULL WHEN f = 3 THEN 'unknown' ELSE {_BY_CLASS}[i + 1] END AS family,
CASE WHEN f = 24 THEN NULL WHEN f = 4 THEN 'pv35' WHEN f = 5 THEN 'x_001' ELSE 'pv_001' END AS asset, CASE WHEN f IN (21, 24) THEN NULL WHEN f = 7 THEN -5 WHEN f = 9 THEN 604700 ELSE i % 7 * 86400 + 500 * i END AS start,
CASE WHEN f IN (23, 24) THEN 0 WHEN (i >= 8) <> (f = 13) THEN 1 ELSE 0 END AS n, CASE WHEN f = 14 THEN 'temperature_c' WHEN f = 15 THEN 'x' WHEN f = 16 THEN 'irradiance_pu' ELSE 'pv_p_kw' END AS variable FROM k),
c AS (SELECT b, g, any_value(author) AS author, count(*) AS scenarios, count(sid) - count(DISTINCT sid) AS again, count(*) FILTER (class = 'normal') AS c0, count(*) FILTER (class = 'cyber_only') AS c1, count(*) FILTER (class = 'physical_only') AS c2, count(*) FILTER (class = 'cyber_physical') AS c3,
[count(*) FILTER (start >= 0 AND start // 86400 = 0), count(*) FILTER (start // 86400 = 1), count(*) FILTER (start // 86400 = 2), count(*) FILTER (start // 86400 = 3), count(*) FILTER (start // 86400 = 4), count(*) FILTER (start // 86400 = 5), count(*) FILTER (start // 86400 = 6)] AS days FROM s GROUP BY 1, 2),
r(b, g, place, rule, severity) AS (
{' UNION ALL '.join(f"SELECT b, g, i, '{rule}', '{severity}' FROM s WHERE {when}" for rule, when, severity in (
    ('type_scenario', 'f = 24', 'ERROR'), ('type_start_time_s', 'f = 21', 'ERROR'), ('type_physical_effects', 'f = 23', 'ERROR'), ('id_pattern', 'f = 0', 'ERROR'),
    ('id_author', "f NOT IN (0, 24) AND (f = 1 OR g = 5)", 'ERROR'), ('class', 'f = 2', 'ERROR'), ('family', 'f = 3', 'ERROR'), ('forbidden_asset', 'f = 4', 'ERROR'), ('asset', 'f = 5', 'ERROR'), ('component', 'f = 6', 'ERROR'),
    ('start_range', 'f IN (7, 21)', 'ERROR'), ('duration_range', 'f = 8', 'ERROR'), ('end_range', 'f = 9', 'ERROR'), ('missing_label_cyber_anomaly', 'f = 11', 'ERROR'), ('cyber_only_effects', "class = 'cyber_only' AND n > 0", 'ERROR'), ('normal_effects', "class = 'normal' AND n > 0", 'ERROR'),
    ('normal_labels', "class = 'normal' AND f IN (11, 12)", 'ERROR'), ('physical_without_effects', "class IN ('physical_only', 'cyber_physical') AND n = 0", 'ERROR'), ('event_level_only', 'f = 18', 'ERROR'), ('packet_claim', 'f = 19', 'ERROR'), ('forbidden_word', 'f = 20', 'ERROR'),
    ('forbidden_variable', 'n > 0 AND f = 14', 'ERROR'), ('variable', 'n > 0 AND f = 15', 'ERROR'), ('irradiance_family', 'n > 0 AND f = 16', 'ERROR'), ('magnitude_bounds', 'n > 0 AND f = 17', 'WARN'),
))}),
o AS (SELECT * FROM r WHERE g NOT IN (0, 1, 7)),
q(b, g, rule) AS (SELECT b, g, 'invalid_json' FROM c WHERE g = 0 UNION ALL SELECT b, g, 'missing_generation_purpose' FROM c WHERE g = 1 UNION ALL SELECT b, g, 'type_scenarios' FROM c WHERE g = 7
UNION ALL {' UNION ALL '.join(f"SELECT b, g, '{rule}' FROM c WHERE g NOT IN (0, 1, 7) AND {when}" for rule, when in (
    ('author_model', 'g = 5'), ('generation_purpose', 'g = 6'), ('compatibility_statement', 'g = 3'), ('scenario_count', 'scenarios <> 16'), ('unique_id', 'again > 0'), ('count_normal', 'c0 <> 4'), ('count_cyber_only', 'c1 <> 4'), ('count_physical_only', 'c2 <> 6'), ('count_cyber_physical', 'c3 <> 2')))}),
m AS (SELECT b, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARN') AS warnings FROM o GROUP BY 1), mq AS (SELECT b, count(*) AS errors FROM q GROUP BY 1),
dq AS (SELECT b, g, 'day_' || d AS rule FROM c LEFT JOIN m USING (b) LEFT JOIN mq USING (b), range(1, 8) x(d) WHERE coalesce(m.errors, 0) = 0 AND coalesce(mq.errors, 0) = 0 AND days[d] NOT BETWEEN 1 AND 4)"""


@_query(f"""WITH {_ROWS} SELECT b AS bundle_id, place, rule, severity FROM o UNION ALL SELECT b, NULL, rule, 'ERROR' FROM q UNION ALL SELECT b, NULL, rule, 'ERROR' FROM dq""")
def bundle_violations(spark, d):
    """Every rule that a bundle, one of its scenarios or effects breaks, broken files and wrong kinds among them."""
    return bundles.violations(_read(spark, d)).select("bundle_id", "place", "rule", "severity")


@_query(f"""WITH {_ROWS}, p AS (SELECT b, sum(CASE WHEN f IN (10, 25, 26) THEN 1 WHEN f = 29 THEN 2 WHEN n > 0 AND f IN (27, 28) THEN 1 ELSE 0 END)::BIGINT AS repairs FROM s WHERE g NOT IN (0, 7) GROUP BY 1),
x AS (SELECT b, count(*) AS n FROM (SELECT b FROM q UNION ALL SELECT b FROM dq) GROUP BY 1)
SELECT c.b AS bundle_id, CASE WHEN g IN (0, 7) THEN 0 ELSE scenarios END AS scenarios, coalesce(m.errors, 0) + coalesce(x.n, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(repairs, 0) + (g = 2)::BIGINT AS repairs, CASE WHEN coalesce(m.errors, 0) + coalesce(x.n, 0) = 0 THEN 'ACCEPTED' ELSE 'REJECTED' END AS status
FROM c LEFT JOIN m USING (b) LEFT JOIN x USING (b) LEFT JOIN p USING (b)""")
def bundle_status(spark, d):
    """Is each bundle accepted, after how many repairs?"""
    return bundles.judged(_read(spark, d)).select("bundle_id", "scenarios", "errors", "warnings", "repairs", "status")


@_query(f"""WITH {_ROWS}, v AS (SELECT * FROM s WHERE g NOT IN (0, 7)),
a AS (SELECT b, 'class' AS dimension, coalesce(class, '?') AS value FROM v UNION ALL SELECT b, 'family', coalesce(family, '?') FROM v UNION ALL SELECT b, 'asset', coalesce(asset, '?') FROM v UNION ALL SELECT b, 'day', 'day_' || (start // 86400 + 1) FROM v WHERE start BETWEEN 0 AND 604799
UNION ALL SELECT b, 'variable', variable FROM v WHERE n > 0) SELECT b AS bundle_id, dimension, value, count(*) AS n FROM a GROUP BY GROUPING SETS ((b, dimension, value), (dimension, value))""")
def bundle_counters(spark, d):
    """Scenarios by class, family, asset and day and effects by variable, of each bundle and of all."""
    return bundles.counters(bundles.scenarios(_read(spark, d)))
