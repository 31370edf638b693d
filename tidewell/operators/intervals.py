"""Interval joins: seconds inside intervals, overlaps, conflicts and point events.

An interval with bounded length is expanded to the buckets it touches and met by an
equi-join, so no nested loop and no cross join is planned, and a hot bucket is one that
adaptive execution can split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import scratch


@dataclass(frozen=True)
class Interval:
    """Names of the bounds; ``closed`` counts the end as inside."""

    start: str
    end: str
    closed: bool = False

    def holds(self, t: Column) -> Column:
        return (t >= F.col(self.start)) & ((t <= F.col(self.end)) if self.closed else (t < F.col(self.end)))

    @property
    def last(self) -> Column:
        return F.col(self.end) if self.closed else F.col(self.end) - 1


def overlap_seconds(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Seconds two closed intervals share."""
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b) + 1)


def inside(points: DataFrame, t: str, intervals: DataFrame, interval: Interval, bucket: int, by: list[str] | None = None) -> DataFrame:
    """Points inside intervals (of the same ``by`` values), by an equi-join on buckets of ``bucket`` seconds."""
    by = by or []
    left = points.withColumn("_bucket", F.floor(F.col(t) / bucket))
    touched = F.sequence(F.floor(F.col(interval.start) / bucket), F.floor(interval.last / bucket))
    right = intervals.filter(F.col(interval.start) <= interval.last).withColumn("_bucket", F.explode(touched))
    return left.join(right, ["_bucket", *by]).filter(interval.holds(F.col(t))).drop("_bucket")


def as_of(points: DataFrame, history: DataFrame, t: str, values: list[str], by: list[str] | None = None, bucket: int = 3600) -> DataFrame:
    """``points`` with the ``values`` of the last row of ``history`` at or before their ``t`` (same ``by``, nulls too), else NULL.

    Rows meet in buckets of time; what earlier buckets end with comes from a table of one row a bucket, so no task
    holds all rows of a key. Of rows at one time the greatest values are the last.
    """
    by = by or []
    point, row = F.struct(*points.columns), F.struct(F.col(t).alias("_t"), *[F.col(v).alias(v) for v in values])
    keys = [F.col(c) for c in (*by, t)]
    marks = points.select(*keys, point.alias("_point")).unionByName(history.select(*keys, row.alias("_row")), allowMissingColumns=True)
    marks = marks.withColumn("_bucket", F.floor(F.col(t) / bucket))
    here = F.last("_row", ignorenulls=True).over(Window.partitionBy(*by, "_bucket").orderBy(t, F.col("_point").isNotNull(), "_row"))
    ends = marks.groupBy(*by, "_bucket").agg(F.max("_row").alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("_bucket", *by, before.alias("_before")).toDF("_in", *[f"_in{i}" for i in range(len(by))], "_before")
    same = F.col("_bucket").eqNullSafe(F.col("_in"))
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_in{i}"))
    found = marks.withColumn("_here", here).filter("_point is not null").join(ends, same)
    last = F.coalesce("_here", "_before")
    return found.select("_point.*", *[last[v].alias(v) for v in values])


def context_windows(anchors: DataFrame, t: str, before: int, after: int, last: int) -> DataFrame:
    """(window_start_s, window_end_s) around each anchor, inside [0, last]."""
    return anchors.withColumns({"window_start_s": F.greatest(F.lit(0), F.col(t) - before), "window_end_s": F.least(F.lit(last), F.col(t) + after)})


def covering(points: DataFrame, t: str, intervals: DataFrame, interval: Interval, bucket: int = 3600, name: str = "covering") -> DataFrame:
    """``points`` with how many intervals hold their ``t``, by a sweep: +1 where one starts, -1 where it ends.

    No interval is expanded and no pair of point and interval is made: the steps are summed within buckets of
    time, and a table of one row a bucket adds what earlier buckets leave. A null ``t`` is in none, empty intervals hold nothing.
    """
    steps = intervals.filter(F.col(interval.start) <= interval.last)
    steps = steps.select(F.explode(F.array(F.struct(F.col(interval.start).alias("t"), F.lit(1).alias("step")), F.struct((interval.last + 1).alias("t"), F.lit(-1).alias("step")))).alias("s"))
    steps = steps.groupBy(F.col("s.t").cast("long").alias("_t")).agg(F.sum("s.step").alias("_step"))
    marks = points.select(F.col(t).cast("long").alias("_t"), F.struct(*points.columns).alias("_point")).unionByName(steps, allowMissingColumns=True)
    marks = marks.withColumn("_bucket", F.floor(F.col("_t") / bucket))
    # steps at a time come before its points: an end is a step one second after the last
    here = F.sum("_step").over(Window.partitionBy("_bucket").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0))
    ends = marks.groupBy("_bucket").agg(F.sum("_step").alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(F.col("_bucket").alias("_in"), before.alias("_before"))
    found = marks.withColumn("_here", here).filter("_point is not null").join(ends, F.col("_bucket").eqNullSafe(F.col("_in")))
    held = F.coalesce("_here", F.lit(0)) + F.coalesce("_before", F.lit(0))
    return found.select("_point.*", F.when(F.col("_t").isNull(), 0).otherwise(held).cast("long").alias(name))


def placed(requests: DataFrame, order: str, duration: str, seconds: int, margin: int = 600, tries: int = 30, bucket: int = 3600, seed: int = 0) -> DataFrame:
    """``requests`` with a random ``start_s`` (NULL where none was found), no two of them overlapping.

    In each round all that are left propose a start: a hash of their ``order`` (unique) and the round. A
    proposal that overlaps a placed interval waits; of proposals that overlap each other, one that has
    no overlapping proposal before it in ``order`` is placed. Overlaps meet by an equi-join on buckets of time. The
    result depends on the hashes alone, not on partitions, and rounds end when all are placed or ``tries`` are used up.
    """
    keep = [F.col(c) for c in requests.columns]
    room = F.lit(seconds - 2 * margin) - F.col(duration)
    fits = F.col(duration).isNotNull() & (F.col(duration) > 0) & (room > 0)
    fitting = requests.filter(F.coalesce(fits, F.lit(False)))
    done = settled(fitting.limit(0).select(*keep, F.lit(0).cast("long").alias("start_s")), "placed")
    for turn in range(tries):
        number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(turn)), F.col(order).cast("string"))), 1, 12), 16, 10).cast("long")
        left = fitting.join(done.select(order), order, "left_anti")
        proposed = settled(left.select(*keep, (number % room + margin).cast("long").alias("start_s")), "proposed")
        if proposed.isEmpty():
            break
        clash = _overlaps(_touched(proposed, duration, bucket), _touched(done, duration, bucket), order, duration).select(order).distinct()
        free = proposed.join(clash, order, "left_anti")
        early = _overlaps(_touched(free, duration, bucket), _touched(free, duration, bucket), order, duration, before=True).select(order).distinct()
        done = settled(done.unionByName(free.join(early, order, "left_anti")), "placed")
    return done.unionByName(requests.join(done.select(order), order, "left_anti").select(*keep, F.lit(None).cast("long").alias("start_s")))


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _touched(rows: DataFrame, duration: str, bucket: int) -> DataFrame:
    last = F.col("start_s") + F.col(duration) - 1
    return rows.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_s") / bucket), F.floor(last / bucket))))


def _overlaps(rows: DataFrame, others: DataFrame, order: str, duration: str, before: bool = False) -> DataFrame:
    """Rows that overlap one of the others (``before``: one of a smaller order), as often as they do."""
    other = others.select("_bucket", F.col(order).alias("_order"), F.col("start_s").alias("_start"), (F.col("start_s") + F.col(duration)).alias("_end"))
    meet = (F.col("start_s") < F.col("_end")) & (F.col("_start") < F.col("start_s") + F.col(duration))
    met = rows.join(other, "_bucket").filter(meet)
    return met.filter(F.col("_order") < F.col(order)) if before else met


def expand(intervals: DataFrame, interval: Interval, step: int = 1, name: str = "time_s") -> DataFrame:
    """A row for each ``step`` of each interval."""
    low, high = F.ceil(F.col(interval.start) / step), F.floor(interval.last / step)
    return intervals.withColumn(name, F.explode(F.when(low <= high, F.sequence(low * step, high * step, F.lit(step).cast("long")))))


def overlap_labels(intervals: DataFrame, interval: Interval, key: str, order: str, labels: list[str], step: int = 1, keep: str = "first") -> DataFrame:
    """A row for each covered step: labels OR-merged, how many intervals, one id or MULTIPLE, all ids in order.

    ``keep`` names whose dimensions stand for the step where several intervals meet: the
    first or the last in ``order``.
    """
    rows = expand(intervals.select(interval.start, interval.end, key, order, *labels), interval, step)
    pick = F.min_by if keep == "first" else F.max_by
    ids = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).cast("string").alias("k"))))
    made = rows.groupBy("time_s").agg(
        F.count("*").alias("active"), pick(key, F.struct(order, key)).alias("_one"), ids.alias("_ids"), *[F.max(c).alias(c) for c in labels]
    )
    return made.select(
        "time_s", "active", F.when(F.col("active") > 1, "MULTIPLE").otherwise(F.col("_one").cast("string")).alias("scenario_id"),
        F.col("_one").alias(f"{keep}_id"), F.array_join(F.transform("_ids", lambda x: x["k"]), "|").alias("active_ids"), *labels,
    )


def align(spine: DataFrame, labels: DataFrame, t: str = "time_s") -> DataFrame:
    """The spine with overlap labels; steps without an interval are BACKGROUND."""
    joined = spine.join(labels, t, "left")
    status = F.when(F.col("active").isNull(), "BACKGROUND").when(F.col("active") > 1, "OVERLAP_MULTIPLE").otherwise("SCENARIO_ACTIVE")
    return joined.withColumn("alignment_status", status).fillna(0, ["active"])


def stamp(spine: DataFrame, events: DataFrame, t: str, kinds: dict[str, Column], step: int = 1) -> DataFrame:
    """The spine with a 0/1 flag for each kind of point event in its step."""
    flags = [F.max(F.when(c, 1).otherwise(0)).alias(name) for name, c in kinds.items()]
    points = events.groupBy((F.floor(F.col(t) / step) * step).alias("time_s")).agg(*flags)
    return spine.join(points, "time_s", "left").fillna(0, list(kinds))


def non_overlapping(intervals: DataFrame, interval: Interval, order: str, bucket: int = 3600) -> DataFrame:
    """Intervals that begin after all before them have ended: the check of a placement.

    The latest end before an interval is that in its bucket of begins, or of earlier buckets; only
    the table of buckets is walked in one task.
    """
    rows = intervals.withColumn("_bucket", F.floor(F.col(interval.start) / bucket))
    ends = rows.groupBy("_bucket").agg(F.max(interval.last).alias("_end"))
    past = F.max("_end").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(F.col("_bucket").alias("_of"), past.alias("_past"))
    before = F.max(interval.last).over(Window.partitionBy("_bucket").orderBy(interval.start, order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", before).join(ends, F.col("_bucket").eqNullSafe(F.col("_of")))
    latest = F.greatest("_before", "_past")
    return rows.filter(latest.isNull() | (latest < F.col(interval.start))).select(*intervals.columns)
