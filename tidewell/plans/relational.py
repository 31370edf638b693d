"""Scans, joins, aggregates, orderings and set operations over the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import metrics, windows
from ..sources.readers import numeric, pick, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _money(column: str):
    """Exact sums of two-digit amounts."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


@_query("SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_price, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '2000-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("date"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(_money("l_quantity").alias("sum_qty"), _money("l_extendedprice").alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-02-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 50000 AND 300000")
def pruned_scan(spark, d):
    o, day = table(spark, d, "orders"), F.col("o_orderdate")
    keep = (day >= F.lit("1998-01-01").cast("date")) & (day < F.lit("1998-02-01").cast("date")) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_totalprice").between(50000, 300000)
    return pick(o.filter(keep), ["o_orderkey", "missing", "o_totalprice"])


@_query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) LIKE '%build%' OR c_name LIKE 'Customer#00000001%'")
def faceted_search(spark, d):
    c = table(spark, d, "customer")
    return c.filter(F.lower("c_mktsegment").contains("build") | F.col("c_name").startswith("Customer#00000001")).select("c_custkey", "c_mktsegment")


@_query("SELECT n_name, count(*) AS orders, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_inner(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("orders"), _money("o_totalprice").alias("revenue"))


@_query("SELECT c_custkey, count(o_orderkey) AS orders, coalesce(max(o_totalprice), 0) AS largest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_left_lookup(spark, d):
    # orders are summed to customers first: the join then moves a row a customer
    sums = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("largest"))
    joined = table(spark, d, "customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("largest", F.lit(0.0)).alias("largest"))


@_query("SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, customers, suppliers FROM (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def join_full_outer(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nationkey", "full_outer")


@_query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_common(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@_query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def anti_unseen(spark, d):
    return table(spark, d, "part").join(table(spark, d, "lineitem").filter("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@_query("(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_ops(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"))
    return c.intersect(table(spark, d, "supplier").select("s_nationkey")).subtract(table(spark, d, "nation").filter("n_regionkey = 0").select("n_nationkey"))


@_query("SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance, NULL AS extra FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, s_name FROM supplier WHERE s_acctbal < 0")
def union_aligned(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal < 0").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    s = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("extra"))
    return c.unionByName(s, allowMissingColumns=True)


_STATUS, _PRIORITY = ("F", "O", "P"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@_query("SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS {s}" for s in _STATUS) + " FROM orders GROUP BY 1")
def pivot_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", list(_STATUS)).count().fillna(0)


@_query("SELECT o_orderpriority, " + ", ".join(f"round(avg(o_totalprice) FILTER (o_orderstatus = '{s}'), 4) AS {s}" for s in _STATUS) + " FROM orders GROUP BY 1")
def pivot_mean(spark, d):
    made = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", list(_STATUS)).avg("o_totalprice")
    return made.select("o_orderpriority", *[F.round(s, 4).alias(s) for s in _STATUS])


@_query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1")
def value_counts(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus is not null").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@_query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, count(*) - count(DISTINCT o_custkey) AS repeats, count(*) FILTER (o_totalprice > 250000) AS large, round(avg((o_orderstatus = 'F')::INT), 6) AS finished FROM orders")
def conditional_counts(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), (F.count("*") - F.count_distinct("o_custkey")).alias("repeats"),
                                         F.count_if(F.col("o_totalprice") > 250000).alias("large"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("finished"))


@_query("SELECT o_custkey, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 5) AS mean, round(stddev_samp(o_totalprice), 3) AS std, arg_min(o_totalprice, o_orderkey) AS first, arg_max(o_totalprice, o_orderkey) AS last FROM orders GROUP BY 1")
def group_statistics(spark, d):
    v = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 5).alias("mean"), F.round(F.stddev_samp(v), 3).alias("std"), F.min_by(v, "o_orderkey").alias("first"), F.max_by(v, "o_orderkey").alias("last"))


@_query("SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|') AS segments, bool_or(c_acctbal < 0) AS any_debt, bool_and(c_acctbal > -2000) AS all_sound FROM customer GROUP BY 1")
def distinct_sets(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "|").alias("segments"), F.bool_or(F.col("c_acctbal") < 0).alias("any_debt"), F.bool_and(F.col("c_acctbal") > -2000).alias("all_sound"))


@_query("SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1")
def exact_quantiles(spark, d):
    q = metrics.percentiles_by(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [50, 90, 99])
    return q.select("l_returnflag", *[F.col("percentiles")[i].alias(n) for i, n in enumerate(("p50", "p90", "p99"))])


@_query("WITH m AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS med FROM lineitem GROUP BY 1) SELECT l_returnflag, med, quantile_cont(abs(l_quantity - med), 0.5) AS mad FROM lineitem JOIN m USING (l_returnflag) GROUP BY ALL")
def median_deviation(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    m = metrics.percentiles_by(rows, ["l_returnflag"], "l_quantity", [50]).select("l_returnflag", F.col("percentiles")[0].alias("med"))
    away = rows.join(F.broadcast(m), "l_returnflag").withColumn("away", F.abs(F.col("l_quantity") - F.col("med")))
    return metrics.percentiles_by(away, ["l_returnflag", "med"], "away", [50]).select("l_returnflag", "med", F.col("percentiles")[0].alias("mad"))


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_n(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@_query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id::VARCHAR), event_id) AS r FROM events) WHERE r <= CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 2 ELSE 3 END")
def stratified_sample(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type").withColumn("h", F.md5(F.concat(F.lit("42:"), F.col("event_id").cast("string"))))
    budget = scalar.choose(F.col("event_type"), {"error": 5, "purchase": 4, "signup": 2}, 3)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("event_type").orderBy("h", "event_id"))
    # the largest budget stands as a number, so that each task keeps no more rows of a class before the shuffle
    return rows.withColumn("r", rank).filter(F.col("r") <= 5).filter(F.col("r") <= budget).select("event_id", "event_type")


@_query("WITH s AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS actual FROM lineitem GROUP BY 1) SELECT o_orderkey, round(o_totalprice - actual, 2) AS residual, round(abs(o_totalprice - actual) / (abs(o_totalprice) + 1), 6) AS relative FROM orders JOIN s ON o_orderkey = l_orderkey")
def residual_join(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(_money("l_extendedprice").alias("actual"))
    rows, gap = table(spark, d, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey")), F.col("o_totalprice") - F.col("actual")
    return rows.select("o_orderkey", F.round(gap, 2).alias("residual"), F.round(scalar.relative_residual(gap, F.col("o_totalprice")), 6).alias("relative"))


@_query("SELECT s_suppkey, split_part(s_name, '#', 1) AS family, substr(s_name, 10) AS rest, lower(s_name) AS low, lpad(s_suppkey::VARCHAR, 6, '0') AS code, CASE WHEN s_acctbal < 0 THEN 'DEBT' WHEN s_acctbal < 5000 THEN 'LOW' ELSE 'HIGH' END AS band, greatest(0.0, least(5000.0, s_acctbal)) AS clipped FROM supplier")
def scalar_functions(spark, d):
    s, b = table(spark, d, "supplier"), F.col("s_acctbal")
    return s.select("s_suppkey", scalar.first_token(F.col("s_name"), "#").alias("family"), scalar.rest_tokens(F.col("s_name"), "#").alias("rest"), F.lower("s_name").alias("low"), scalar.padded_id("", F.col("s_suppkey"), 6).alias("code"),
                    F.when(b < 0, "DEBT").when(b < 5000, "LOW").otherwise("HIGH").alias("band"), scalar.clip(b, 0.0, 5000.0).alias("clipped"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(TRY_CAST(event_type AS DOUBLE), -1)::DOUBLE AS coerced FROM events")
def json_props(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), numeric("event_type", -1.0, "double").alias("coerced"))


@_query("SELECT conv_id, turn, regexp_extract('Answer: ```json {\"turn\": ' || turn || ', \"role\": \"' || role || '\"} ``` done', '\\{.*\\}', 0) AS object, turn AS turn_read, role AS role_read FROM conversations")
def json_extract_text(spark, d):
    c = table(spark, d, "conversations")
    text = F.concat(F.lit('Answer: ```json {"turn": '), F.col("turn").cast("string"), F.lit(', "role": "'), F.col("role"), F.lit('"} ``` done'))
    found = scalar.json_object_text(text)
    read = F.from_json(found, "turn bigint, role string")
    return c.select("conv_id", "turn", found.alias("object"), read["turn"].alias("turn_read"), read["role"].alias("role_read"))


@_query("WITH u AS (SELECT o_orderkey, u.name, u.v FROM orders, LATERAL (VALUES ('price', o_totalprice), ('year', year(o_orderdate)::DOUBLE), ('cust', o_custkey::DOUBLE)) u(name, v)) SELECT name, count(*) AS n, max(v) AS top FROM u GROUP BY name")
def unpivot_measures(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.year("o_orderdate").cast("double").alias("year"), F.col("o_custkey").cast("double").alias("cust"))
    return o.unpivot(["o_orderkey"], ["price", "year", "cust"], "name", "v").groupBy("name").agg(F.count("*").alias("n"), F.max("v").alias("top"))


@_query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS r FROM lineitem) SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM r WHERE r = 1")
def first_per_key(spark, d):
    made = windows.best_per_group(table(spark, d, "lineitem"), ["l_partkey"], F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_suppkey"))
    return made.select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@_query("SELECT n_nationkey, CAST(to_json({name: n_name, region: r_name, suppliers: coalesce(s, [])}) AS VARCHAR) AS doc FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, list({id: s_suppkey, balance: s_acctbal} ORDER BY s_suppkey) AS s FROM supplier WHERE s_acctbal > 8000 GROUP BY 1) ON s_nationkey = n_nationkey")
def nested_documents(spark, d):
    s = table(spark, d, "supplier").filter("s_acctbal > 8000").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))).alias("s"))
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    none = F.array().cast("array<struct<id:bigint,balance:double>>")
    return rows.select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("r_name").alias("region"), F.coalesce("s", none).alias("suppliers"))).alias("doc"))
