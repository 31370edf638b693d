"""Every registered relational and time-series query against its SQL in another engine."""

from __future__ import annotations

import math
import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tidewell.plans import catalog, ingest

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v if v is None or isinstance(v, (int, str)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    if name not in catalog.SQL:
        assert rows and len(set(df.columns)) == len(df.columns)
        return
    found = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in found.description]
    other = found.fetchall()
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    ours = sorted(([plain(r[c]) for c in order] for r in rows), key=str)
    theirs = sorted(([plain(r[columns.index(c)]) for c in order] for r in other), key=str)
    assert ours == theirs


def test_stacked_scores_of_every_document(spark):
    found = catalog.QUERIES["stacked_scores"](spark, str(DATA)).collect()
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").collect())


def test_detections_go_on_with_the_events(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    kind = dict(events.dtypes)["ts"]
    later = events.withColumn("ts", (F.col("ts") + F.expr("INTERVAL 40 DAYS")).cast(kind)).unionByName(events)
    later.write.parquet(str(tmp_path / "events.parquet"))
    found = catalog.QUERIES["detection_overlap_seconds"](spark, str(tmp_path))
    assert found.agg(F.max("detection_id")).first()[0] > 718


def test_signal_directions_of_rows_of_one_second(spark, tmp_path):
    """The first and the last second of a window hold several events; the one with the least id counts, wherever it is read."""
    duckdb = pytest.importorskip("duckdb")
    stamp = F.expr("timestamp_micros(unix_micros(timestamp'2024-01-01 00:00:00') + (id div 8 * 86400 + (id % 8 div 4) * 60) * 1000000 + id)")
    value = F.when(F.col("id") % 8 < 4, F.lit(50.0)).otherwise(F.element_at(F.array(*map(F.lit, (40.0, 60.0, 45.0, 70.0))), (F.col("id") % 4 + 1).cast("int")) + F.col("id") % 16)
    value = F.when(F.col("id") % 8 == 3, 100.0).otherwise(value)
    rows = spark.range(64).select(F.col("id").alias("event_id"), stamp.cast("timestamp_ntz").alias("ts"), (F.col("id") % 5).alias("user_id"), F.lit("view").alias("event_type"), value.alias("value"), F.lit("{}").alias("props"))
    rows.repartitionByRange(5, F.desc("event_id")).sortWithinPartitions(F.desc("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create table events as select * from '{tmp_path}/events.parquet/*.parquet' order by event_id")
    theirs = con.execute("select detection_id, signal, direction from (" + catalog.SQL["signal_directions"] + ")").fetchall()
    ours = [(r.detection_id, r.signal, r.direction) for r in catalog.QUERIES["signal_directions"](spark, str(tmp_path)).collect()]
    assert sorted(ours) == sorted(theirs) and {x[2] for x in theirs} >= {"increase", "decrease"}


def test_median_deviation_does_not_bring_a_group_to_a_task(spark, monkeypatch):
    """Medians are a row a group: they go to the rows."""
    frame, plans = type(spark.range(0)), []
    collect = frame.collect

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return collect(df)

    monkeypatch.setattr(frame, "collect", seen)
    catalog.QUERIES["median_deviation"](spark, str(DATA))
    joins = [line for p in plans for line in p.splitlines() if "Join Inner" in line]
    assert joins and all("strategy=broadcast" in line for line in joins)


def test_json_lines_are_written_by_several_tasks(spark, monkeypatch, tmp_path):
    """Ranges of orders are files of their own, and the last order of a customer is still the one that counts."""
    from tidewell.plans import exchange

    orders = spark.range(60_000).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7 % 501).alias("o_custkey"))
    orders.repartition(3, F.hash("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(exchange.sinks, "scratch", lambda spark, name: str(tmp_path / name))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "50k")
    try:
        got = {r.o_custkey: (r.o_orderkey, r.turn) for r in catalog.QUERIES["json_lines_last"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    last = {k * 7 % 501: k for k in range(60_000)}
    assert got == {c: (k, k % 7) for c, k in last.items()}
    assert len(list((tmp_path / "lines").glob("part-*.json"))) > 1


def test_bundle_violations_judge_scenarios_once(spark):
    """What is returned reads the judged scenarios from a table; no scenario is taken out of its document again."""
    found = catalog.QUERIES["bundle_violations"](spark, str(DATA))
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_documents_of_bundles_are_made_by_compiled_code(spark, capsys):
    """Java leaves a method of over 8,000 bytes of code to its interpreter."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no code before it runs
    try:
        ingest._documents(spark, str(DATA)).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_bundle_status_parses_a_document_once_a_side(spark):
    """Rules read columns: none parses a scenario's context again, and kinds are asked for once a field."""
    most = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = catalog.QUERIES["bundle_status"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", most)
    assert plan.count("parseJson") == 2 and plan.count("schemaOfVariant(") < 60
