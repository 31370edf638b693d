"""Sources and sinks by round trip, and helpers of rows and texts, with their SQL.

What is written goes to a folder of its own in the shared scratch space and is read back, so that
a query's result shows both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.timeaxis import iso
from ..operators import detectors, metrics, quality, windows
from ..sources import readers, sinks
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


@_query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_totalprice > 100000")
def csv_round_trip(spark, d):
    """Written as CSV with a header, read again with declared types and only three columns."""
    path = sinks.scratch(spark, "csv")
    sinks.write_csv(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"), path)
    rows = readers.csv(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_totalprice double", ["o_orderkey", "o_orderpriority", "o_totalprice"])
    return rows.filter("o_totalprice > 100000")


@_query("SELECT count(*)::BIGINT AS n, count(DISTINCT o_orderpriority) AS priorities, round(sum(o_totalprice::DECIMAL(18, 2)), 2)::DOUBLE AS total FROM orders")
def csv_inferred(spark, d):
    """Types are inferred; the count of rows is that of the lines less headers."""
    path = sinks.scratch(spark, "csv")
    sinks.write_csv(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path)
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return rows.agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("priorities"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total"))


@_query("SELECT n_nationkey::BIGINT AS hour, (n_nationkey * 0.5)::DOUBLE AS v1, n_regionkey::DOUBLE AS i1 FROM nation")
def padded_export(spark, d):
    """A monitor's export, with spaces around its header and its fields."""
    path = sinks.scratch(spark, "monitor")
    line = F.format_string(" %d ,  %s,   %s ", "n_nationkey", (F.col("n_nationkey") * 0.5).cast("string"), F.col("n_regionkey").cast("double").cast("string"))
    rows = spark.range(1).select(F.lit(" hour ,  V1,   I1 ").alias("value")).unionByName(table(spark, d, "nation").select(line.alias("value")))
    sinks.write_text(rows.coalesce(1), path)
    return readers.csv(spark, path, "hour bigint, v1 double, i1 double", padded=True)


@_query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, max(o_orderkey) % 7 AS turn FROM orders GROUP BY 1")
def json_lines_last(spark, d):
    """JSON lines, of which the last one with a key counts: files by ranges of the order's key, so that paths are in its order, too."""
    path = sinks.scratch(spark, "lines")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 7).alias("turn"))
    sinks.write_json_lines(rows.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey"), path)
    return readers.json_lines(spark, path, "o_custkey", "o_custkey bigint, o_orderkey bigint, turn bigint")


@_query("SELECT r_name, n_name, n_nationkey::BIGINT AS n_nationkey FROM region JOIN nation ON r_regionkey = n_regionkey")
def json_bundles(spark, d):
    """A document a region, in folders of their own, found at any depth and exploded."""
    path = sinks.scratch(spark, "bundles")
    joined = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    docs = joined.groupBy("r_regionkey", "r_name").agg(F.collect_list(F.struct("n_name", "n_nationkey")).alias("nations"))
    docs.select("r_regionkey", "r_name", "nations").repartition("r_regionkey").write.partitionBy("r_regionkey").json(path)
    found = readers.json_documents(spark, path, "r_name string, nations array<struct<n_name:string,n_nationkey:bigint>>")
    return found.select("r_name", F.inline("nations"))


@_query("SELECT 'a' AS model, o_orderkey, o_totalprice AS score, NULL::DOUBLE AS threshold FROM orders UNION ALL SELECT 'b', o_orderkey, o_totalprice / 2, 5.0 FROM orders")
def appended_scores(spark, d):
    """Scores appended a model at a time; a column that only later ones have reads as NULL."""
    path, rows = sinks.scratch(spark, "scores"), table(spark, d, "orders")
    sinks.write_table(rows.select(F.lit("a").alias("model"), "o_orderkey", F.col("o_totalprice").alias("score")), path)
    sinks.append_aligned(rows.select(F.lit("b").alias("model"), "o_orderkey", (F.col("o_totalprice") / 2).alias("score"), F.lit(5.0).alias("threshold")), path)
    return sinks.read_aligned(spark, path).select("model", "o_orderkey", "score", "threshold")


@_query("SELECT n_nationkey::BIGINT AS id, n_name || ' <&> ' || n_regionkey AS name FROM nation")
def xml_round_trip(spark, d):
    """A document a row from a template, with characters of the markup in its values, parsed again."""
    name = F.concat("n_name", F.lit(" <&> "), F.col("n_regionkey").cast("string"))
    made = sinks.xml_text(table(spark, d, "nation"), "<control><id>{id}</id><name>{name}</name></control>", id=F.col("n_nationkey"), name=name)
    path = sinks.scratch(spark, "xml")
    sinks.write_text(made, path)
    return readers.xml_lines(spark, path, "id bigint, name string")


@_query("""SELECT n_regionkey, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS report FROM nation GROUP BY 1""")
def markdown_reports(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(sinks.markdown_lines("n_nationkey", ["n_nationkey", "n_name"]).alias("report"))


#: Lines of a supplier's model script and settings: (place, text before the number, multiplier, text behind it).
_SCRIPT = ((1, "! ratings of site ", 1, ""), (2, "New PVSystem.pv", 1, " phases=3 kVA=110 ! rated"), (3, "~ Pmpp=", 10, " irradiance=1.0"), (4, "New Storage.bess", 1, " kVA=55"), (5, "~ kWrated=", 5, " %reserve=10"), (6, "More kWhrated=", 7, " enabled=yes"), (7, "set mode=daily", 0, ""))
_YAML = ((1, "# site ", 1, ""), (2, 'site: "north', 1, '"'), (3, "pv:", 0, ""), (4, "  kva: ", 12, "   # upper"), (5, "  kw: 90", 0, ""), (6, "bess:", 0, ""), (7, "  soc_min: '", 1, "'"),
         (8, "limits:", 0, ""), (9, "  pcc:", 0, ""), (10, "    low: -", 3, ""), (11, "    phases:", 0, ""), (12, "    - a", 1, "  # first"), (13, '    - "b"', 0, ""), (14, "  names:", 0, ""), (15, "    - n", 2, ""), (16, "last: yes", 0, ""))


def _texts(spark, d: str, lines: tuple) -> DataFrame:
    """The lines of each supplier's file."""
    k = F.col("s_suppkey")
    each = F.array(*[F.struct(F.lit(i).alias("line"), F.concat(F.lit(before), F.when(F.lit(m) > 0, (k * m).cast("string")).otherwise(""), F.lit(behind)).alias("value")) for i, before, m, behind in lines])
    return table(spark, d, "supplier").select(k.cast("string").alias("source_path"), F.inline(each))


@_query("""WITH k AS (SELECT s_suppkey AS n FROM supplier) SELECT n::VARCHAR AS site, u.* FROM k, LATERAL (VALUES ('PVSystem.pv' || n, 'phases', '3'), ('PVSystem.pv' || n, 'kva', '110'), ('PVSystem.pv' || n, 'pmpp', (n * 10)::VARCHAR), ('PVSystem.pv' || n, 'irradiance', '1.0'), ('Storage.bess' || n, 'kva', '55'),
('Storage.bess' || n, 'kwrated', (n * 5)::VARCHAR), ('Storage.bess' || n, 'kwhrated', (n * 7)::VARCHAR), ('Storage.bess' || n, '%reserve', '10'), ('Storage.bess' || n, 'enabled', 'yes')) u(object, "key", "value")""")
def script_ratings(spark, d):
    """Objects and settings of each supplier's model script, by line."""
    return readers.network_objects(_texts(spark, d, _SCRIPT)).select(F.col("source_path").alias("site"), "object", "key", "value")


@_query("""WITH k AS (SELECT s_suppkey AS n FROM supplier) SELECT n::VARCHAR AS name, u.* FROM k, LATERAL (VALUES (NULL, 'site', 'north' || n), ('pv', 'kva', (n * 12)::VARCHAR), ('pv', 'kw', '90'), ('bess', 'soc_min', n::VARCHAR), ('limits.pcc', 'low', '-' || n * 3), ('limits.pcc.phases', '0', 'a' || n), ('limits.pcc.phases', '1', 'b'), ('limits.names', '0', 'n' || n * 2), (NULL, 'last', 'yes')) u(section, "key", "value")""")
def yaml_settings(spark, d):
    """Settings of each supplier's file, with sections in sections and lists."""
    return readers.settings(_texts(spark, d, _YAML), "line").select(F.col("source_path").alias("name"), "section", "key", "value")


@_query("""WITH k AS (SELECT s_suppkey AS n FROM supplier) SELECT n::VARCHAR AS name, u.* FROM k, LATERAL (VALUES ('pv_kva', '110', 'script'), ('pv_kw', '90', 'yaml'), ('bess_kva', '55', 'script'), ('bess_soc_min', n::VARCHAR, 'yaml'), ('bess_kwh', '200', 'default')) u("key", "value", source)""")
def rating_priority(spark, d):
    """Defaults, then YAML, then the script of each supplier; each setting with the source that decided it."""
    yaml = readers.settings(_texts(spark, d, _YAML), "line").filter("section in ('pv', 'bess')").select(F.col("source_path").alias("name"), F.concat_ws("_", "section", "key").alias("key"), "value", F.lit("yaml").alias("source"))
    script = readers.network_objects(_texts(spark, d, _SCRIPT)).filter("key = 'kva'").select(F.col("source_path").alias("name"), F.concat(F.regexp_extract("object", r"\.([a-z]+)", 1), F.lit("_kva")).alias("key"), "value", F.lit("script").alias("source"))
    known = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"), F.lit("default").alias("source")) for k, v in (("pv_kva", "100"), ("bess_kva", "50"), ("bess_kwh", "200"))])
    defaults = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("name"), F.inline(known))
    return readers.ratings(defaults.unionByName(yaml).unionByName(script), ["default", "yaml", "script"], ["name"])


@_query("SELECT r_name AS name, CASE WHEN r_name = 'AMERICA' THEN 'americas' WHEN r_name LIKE 'MIDDLE%' THEN 'middle' ELSE 'other' END AS kind, length(r_name)::BIGINT + 1 AS length, sha256(r_name || chr(10)) AS digest FROM region WHERE r_name <> 'ASIA'")
def file_inventory(spark, d):
    """Files by suffix, outside a folder to skip, with their class and the digest of their head."""
    path, rows = sinks.scratch(spark, "files"), table(spark, d, "region")
    sinks.write_text_files(rows.select((F.when(F.col("r_name") == "ASIA", "old").otherwise("new")).alias("folder"), F.col("r_name").alias("name"), F.col("r_name").alias("value")), path)
    found = readers.files(spark, path, [".txt"], ["folder=old"])
    marked = readers.classified(found.drop("name").withColumn("name", F.regexp_extract("path", r"name=([^/]+)/", 1)), {"americas": ["america"], "middle": ["middle", "east"]}, "name")
    return marked.join(readers.fingerprints(spark, path).select("path", "digest"), "path").select("name", "kind", "length", "digest")


_F = f"{_E}, w AS (SELECT event_id, user_id % 3 AS m, CASE WHEN user_id % 3 = 0 THEN 'clean' ELSE 'attacked' END AS source_dataset, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, CASE WHEN t % 5 < 3 THEN 'train' ELSE 'test' END AS split, value, t FROM e)"


def _windows(spark, d) -> DataFrame:
    rows = _events(spark, d)
    return rows.select("event_id", F.when(F.col("user_id") % 3 == 0, "clean").otherwise("attacked").alias("source_dataset"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"),
                       F.when(F.col("t") % 5 < 3, "train").otherwise("test").alias("split"), "value", F.col("t").cast("double").alias("t"))


@_query(f"WITH {_F} SELECT event_id, source_dataset, y, split, value AS x0, t::DOUBLE AS x1 FROM w WHERE split = 'test'")
def split_rows(spark, d):
    """One split's windows: their features as one array, beside labels and the rest."""
    return readers.window_rows(_windows(spark, d), ["value", "t"], "test").select("event_id", "source_dataset", "y", "split", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


@_query(f"WITH {_F} SELECT count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM w WHERE split = 'train' AND source_dataset = 'clean' AND y = 0")
def training_rows(spark, d):
    """The clean and normal rows of the training split, and their standard parameters."""
    rows = readers.window_rows(_windows(spark, d), ["value"], "train", training=True)
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.col("x")[0]), 6).alias("mean"), F.round(F.stddev_pop(F.col("x")[0]), 6).alias("std"))


@_query(f"WITH {_F}, p AS (SELECT avg(value) AS mean, stddev_pop(value) + 1e-8 AS s FROM w WHERE split = 'train') SELECT event_id, round((value - mean) / s, 6) AS z FROM w, p WHERE split = 'test'")
def standard_scores(spark, d):
    """Test rows by the mean and spread of training."""
    rows = _windows(spark, d)
    parameters = detectors.standard_parameters(rows.filter("split = 'train'"), ["value"])
    return detectors.standardize(rows.filter("split = 'test'"), parameters).select("event_id", F.round("value", 6).alias("z"))


@_query(f"""WITH {_E} SELECT event_id, event_id || ' is ' || event_type AS filled, strftime(TIMESTAMP '2024-01-01' + to_seconds(t), '%Y-%m-%dT%H:%M:%S.000Z') AS stamp, round(value, 1) AS one_digit, trunc(value)::INT AS whole, event_type || '|' || user_id AS piped,
'de' || substr(sha256(event_id::VARCHAR), 1, 8) AS short_id, abs(value - 100) > 0.01 AS moved, CASE WHEN event_type = 'view' THEN ['view', 'x'] ELSE ['x', event_type] END AS parts FROM e""")
def text_helpers(spark, d):
    from ..operators.explain import filled

    c = F.col
    first = F.when(c("event_type") == "view", F.lit("view"))
    return _events(spark, d).select(
        "event_id", iso(c("t"), "2024-01-01 00:00:00", True).alias("stamp"), F.round("value", 1).alias("one_digit"), c("value").cast("int").alias("whole"), F.concat_ws("|", "event_type", c("user_id").cast("string")).alias("piped"),
        filled("{{id}} is {{kind}}", {"id": c("event_id"), "kind": c("event_type")}).alias("filled"), F.concat(F.lit("de"), F.substring(F.sha2(c("event_id").cast("string"), 256), 1, 8)).alias("short_id"),
        (F.abs(c("value") - 100) > 0.01).alias("moved"), scalar.distinct_in_order(F.array(first, F.lit("x"), F.lit(""), c("event_type"), F.lit("x"))).alias("parts"),
    )


@_query("SELECT o_orderkey, coalesce(o_clerk, o_comment) AS label, o_orderstatus AS status FROM (SELECT o_orderkey, o_orderpriority AS o_clerk, 'z' AS o_comment, o_orderstatus FROM orders)")
def first_column(spark, d):
    """The first of several names that a table has."""
    rows = readers.first_available(table(spark, d, "orders"), ["priority", "o_orderpriority", "o_orderstatus"], "label")
    return readers.first_available(rows, ["state", "o_orderstatus"], "status").select("o_orderkey", "label", "status")


@_query(f"""WITH {_E}, x AS (SELECT *, t // 7200 AS k, row_number() OVER (PARTITION BY t // 7200 ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY t // 7200) AS n FROM e)
SELECT event_id, first_value(value) OVER (PARTITION BY k ORDER BY t, event_id) AS held, round(least(1.0, greatest(0.0, (t - k * 7200 - 600) / 1800.0)), 6) AS ramp,
round(CASE WHEN i < greatest(1, n // 3) THEN i / greatest(1, n // 3) WHEN i < n - greatest(1, n // 3) THEN 1.0 ELSE (n - i) / greatest(1, n // 3) END, 6) AS profile FROM x""")
def interval_shapes(spark, d):
    """The first value held over an interval, a ramp from its start, and a trapezoid over its rows."""
    from pyspark.sql import Window

    rows = _events(spark, d).withColumn("k", F.floor(F.col("t") / 7200))
    w = Window.partitionBy("k")
    rows = rows.withColumns({"i": F.row_number().over(w.orderBy("t", "event_id")) - 1, "n": F.count("*").over(w)})
    made = windows.held_first(rows, ["k"], ["t", "event_id"], "value")
    return made.select("event_id", "held", F.round(windows.ramp_factor(F.col("t"), F.col("k") * 7200 + 600, F.lit(1800)), 6).alias("ramp"), F.round(windows.trapezoid(F.col("i"), F.col("n")), 6).alias("profile"))


@_query(f"WITH {_E} SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 80 THEN 'COMPLETE' WHEN count(*) >= 60 THEN 'PARTIAL' ELSE 'INCOMPLETE' END AS verdict FROM e GROUP BY 1")
def completion_verdicts(spark, d):
    return _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).withColumn("verdict", metrics.verdict(F.col("n"), 80, 60))


@_query("SELECT n_name AS feature, word FROM nation, (VALUES ('1'), ('N_2')) v(word) WHERE contains(n_name, word)")
def leakage_names(spark, d):
    """Names that hold a denied word; the words stand in the plan."""
    return quality.denied_names(table(spark, d, "nation").select(F.col("n_name").alias("feature")), ["1", "N_2"])


@_query("""SELECT * FROM (SELECT 'row_count' AS check_name, abs(count(*) - 1000)::BIGINT AS violations, 'FAIL' AS severity FROM orders UNION ALL
SELECT 'urgent_is_dearer', CASE WHEN avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') > avg(o_totalprice) FILTER (o_orderpriority = '5-LOW') THEN 0 ELSE 1 END, 'WARN' FROM orders UNION ALL
SELECT 'has_o_clerk_id', 1, 'FAIL' UNION ALL SELECT 'has_o_orderkey', 0, 'FAIL') t""".replace("SELECT * FROM (", "SELECT check_name, violations, CASE WHEN violations = 0 THEN 'PASS' ELSE severity END AS status FROM (", 1))
def table_checks(spark, d):
    """An expected count, a comparison of means, and columns that must be there."""
    rows = table(spark, d, "orders")
    found = quality.greater_mean("urgent_is_dearer", "o_totalprice", F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW")
    return quality.run_checks(rows, [quality.row_count(1000), found, *quality.has_columns(rows, ["o_clerk_id", "o_orderkey"])])


@_query("SELECT sum((l.k IS NULL OR r.k IS NULL)::INT)::BIGINT AS unmatched, sum((l.v <> r.v)::INT)::BIGINT AS unequal, min(l.k) AS first_key, max(l.k) AS last_key FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders) l FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 13 <> 0) r ON l.k = r.k")
def aligned_tables(spark, d):
    """Two tables that must agree on keys and on a value: what is on one side only, what differs, and the ends."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    other = rows.filter("k % 13 <> 0").withColumn("v", F.when(F.col("k") % 11 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return quality.equal_on(rows, other, "k", ["v"])


@_query("SELECT s_suppkey, c_custkey FROM supplier RIGHT JOIN customer ON s_suppkey = c_custkey")
def join_right_outer(spark, d):
    """Every customer, with the supplier of the same number where there is one."""
    return table(spark, d, "supplier").join(table(spark, d, "customer"), F.col("s_suppkey") == F.col("c_custkey"), "right").select("s_suppkey", "c_custkey")


@_query("WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders) SELECT o_orderpriority, o_orderkey FROM r WHERE k = 1 ORDER BY o_orderkey LIMIT 3")
def first_of_each_kind(spark, d):
    """The first row of each kind by id, and of these the first three."""
    return windows.best_per_group(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_orderkey")).select("o_orderpriority", "o_orderkey").orderBy("o_orderkey").limit(3)


@_query("SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 100")
def random_subsample(spark, d):
    """A hundred rows without replacement, the same in every run: the sampling is the feature."""
    h = F.md5(F.concat(F.lit("7:"), F.col("o_orderkey").cast("string")))
    return table(spark, d, "orders").orderBy(h, "o_orderkey").limit(100).select("o_orderkey")
