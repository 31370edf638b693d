"""Hopping windows, window features and ordered analytics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATISTICS = ("mean", "std", "min", "max", "median", "slope", "first", "last", "delta", "rms")


def hopping(df: DataFrame, t: str, width: int, stride: int, length: int | None = None, name: str = "window_id") -> DataFrame:
    """Each row once for every full window [k * stride, k * stride + width) that holds it.

    ``length`` is the axis' length in seconds (its last second plus one by default, from
    one narrow aggregation); windows that would reach past it are left out.
    """
    if length is None:
        length = (df.agg(F.max(t)).first()[0] or -1) + 1
    last = (length - width) // stride
    low = F.greatest(F.lit(0), F.ceil((F.col(t) - width + 1) / stride)).cast("long")
    high = F.least(F.lit(last), F.floor(F.col(t) / stride)).cast("long")
    return df.withColumn(name, F.explode(F.when(low <= high, F.sequence(low, high))))


def statistics(value: str, t: str, order: Column, prefix: str = "", digits: int | None = None) -> list[Column]:
    """The ten statistics of a window, as aggregates that combine before the shuffle where they can."""
    v = F.col(value)
    first, last = F.min_by(v, order), F.max_by(v, order)
    made = {
        "mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v), "median": F.percentile(v, F.lit(0.5)),
        "slope": F.coalesce(F.regr_slope(v, F.col(t).cast("double")), F.lit(0.0)),
        "first": first, "last": last, "delta": last - first, "rms": F.sqrt(F.avg(v * v)),
    }
    return [(made[s] if digits is None else F.round(made[s], digits)).alias(f"{prefix}{s}") for s in STATISTICS]


def window_features(df: DataFrame, t: str, values: list[str], width: int, stride: int, order: str, length: int | None = None, digits: int | None = None) -> DataFrame:
    """(window_id, window_start_s, n, statistics of each value)."""
    one = len(values) == 1
    made = [c for v in values for c in statistics(v, t, F.col(order), "" if one else f"{v}_", digits)]
    rows = hopping(df.select(t, order, *values), t, width, stride, length)
    return rows.groupBy("window_id").agg((F.first("window_id") * stride).alias("window_start_s"), F.count("*").alias("n"), *made)


def dominant(df: DataFrame, keys: list[str], value: str, order: str, name: str = "dominant") -> DataFrame:
    """The most frequent non-empty value of each group; of equals, the one seen first."""
    counts = df.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(name), F.max("_n").alias("votes"))


def ramp(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "ramp") -> DataFrame:
    """Change from the row before; 0 at the first."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.col(value) - F.lag(value, 1).over(w)).fillna(0.0, [name])


def gaps(df: DataFrame, by: list[str], t: str, longest: int) -> DataFrame:
    """Places where the next row is over ``longest`` away."""
    w = Window.partitionBy(*by).orderBy(t)
    return df.withColumn("next_t", F.lead(t).over(w)).withColumn("gap", F.col("next_t") - F.col(t)).filter(F.col("gap") > longest)


def _ranked(df: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Rows with ``_place``, their rank from 0, and ``_n``, the number of rows.

    ``bucket`` is a coarse, rising function of the order, such as the hour. A row's rank is its
    place in its bucket plus the rows of earlier buckets, so only buckets are sorted, and only the
    table of buckets is summed in one task.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("_bucket").alias("_of"), before.alias("_before"), F.sum("_size").over(Window.partitionBy()).alias("_n"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    ranked = rows.withColumn("_place", place).join(sizes, F.col("_bucket").eqNullSafe(F.col("_of")))
    return ranked.withColumn("_place", F.col("_place") + F.col("_before")).drop("_bucket", "_of", "_before")


def _split(train: float, validation: float) -> Column:
    share = lambda s: F.col("_place") < F.floor(F.col("_n") * s)
    return F.when(share(train), "train").when(share(train + validation), "validation").otherwise("test")


def time_split(df: DataFrame, order: list[str], bucket: Column, train: float = 0.6, validation: float = 0.2, name: str = "split") -> DataFrame:
    """Train, validation and test by rank in ``order``; ``bucket`` is a coarse, rising function of it."""
    return _ranked(df, order, bucket).withColumn(name, _split(train, validation)).select(*df.columns, name)


def group_split(df: DataFrame, group: str, t: str, train: float = 0.6, validation: float = 0.2, bucket: int = 3600) -> DataFrame:
    """(group, first_t, rank, split): whole groups by their first appearance."""
    first = df.groupBy(group).agg(F.min(t).alias("first_t"))
    ranked = _ranked(first, ["first_t", group], F.floor(F.col("first_t") / bucket))
    return ranked.select(group, "first_t", F.col("_place").alias("rank"), _split(train, validation).alias("split"))


def detection_latency(df: DataFrame, by: str, order: list[str], truth: Column, predicted: Column) -> DataFrame:
    """(by, onset, detected, latency): rows from the first true row to the first hit; what is left where there is none."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    rows = df.select(by, place.alias("i"), truth.cast("boolean").alias("y"), predicted.cast("boolean").alias("p"))
    seen = rows.groupBy(by).agg(F.count("*").alias("n"), F.min(F.when(F.col("y"), F.col("i"))).alias("onset"), F.min(F.when(F.col("y") & F.col("p"), F.col("i"))).alias("detected"))
    seen = seen.filter("onset is not null")
    return seen.select(by, "onset", "detected", F.coalesce(F.col("detected") - F.col("onset"), F.col("n") - F.col("onset")).alias("latency"))


def downsample(df: DataFrame, t: str, value: str, factor: int, by: list[str] | None = None) -> DataFrame:
    """Mean of each block of ``factor`` seconds; the unfinished last block is left out."""
    by = by or []
    end = (df.agg(F.max(t)).first()[0] or -1) + 1
    blocks = df.groupBy(*by, F.floor(F.col(t) / factor).alias("block")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return blocks.filter(F.col("block") < end // factor)


def every_nth(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """Every k-th row of each group, k the smallest step that leaves ``most`` rows at most."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    step = F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy(*by)) / most))
    return df.withColumn("_i", place).withColumn("_step", step).filter(F.col("_i") % F.col("_step") == 0).drop("_i", "_step")


def best_per_group(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_r", rank).filter("_r = 1").drop("_r")


@dataclass(frozen=True)
class Fold:
    """Maps of a level that are closed under composition, so that runs of rows combine like sums do."""

    #: The map that changes nothing, as a struct; one map after another; the value of a map.
    identity: Column
    then: Callable[[Column, Column], Column]
    at: Callable[[Column, Column], Column]


def _within(x: Column, m: Column) -> Column:
    return F.least(m["hi"], F.greatest(m["lo"], x))


def clamp(step: Column, low: float, high: float) -> Column:
    """x to min(high, max(low, x + step)), as a map of ``clamps``."""
    return F.struct(step.cast("double").alias("s"), F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"))


def clamps() -> Fold:
    def then(m: Column, r: Column) -> Column:
        return F.struct((m["s"] + r["s"]).alias("s"), _within(m["lo"] + r["s"], r).alias("lo"), _within(m["hi"] + r["s"], r).alias("hi"))

    return Fold(clamp(F.lit(0.0), float("-inf"), float("inf")), then, lambda m, x: _within(x + m["s"], m))


def affine(scale: Column, shift: Column) -> Column:
    return F.struct(scale.cast("double").alias("m"), shift.cast("double").alias("b"))


def affines() -> Fold:
    return Fold(affine(F.lit(1.0), F.lit(0.0)), lambda m, r: affine(r["m"] * m["m"], r["m"] * m["b"] + r["b"]), lambda m, x: m["m"] * x + m["b"])


def _buckets(df: DataFrame, by: list[str], order: list[str], bucket: Column, step: Column, fold: Fold) -> DataFrame:
    """(by, _b, _xs, _map): the rows of each bucket in order, and the map they make together."""
    rows = df.select(*by, bucket.alias("_b"), F.struct(*order, step.alias("_m")).alias("_x")).groupBy(*by, "_b").agg(F.array_sort(F.collect_list("_x")).alias("_xs"))
    return rows.withColumn("_map", F.aggregate("_xs", fold.identity, lambda m, x: fold.then(m, x["_m"])))


def last_level(df: DataFrame, by: list[str], order: list[str], bucket: Column, step: Column, fold: Fold, start: float) -> DataFrame:
    """(by, steps, level) after all rows of a key: buckets fold side by side, then a key's few maps."""
    maps = _buckets(df, by, order, bucket, step, fold).groupBy(*by).agg(F.sum(F.size("_xs")).alias("steps"), F.array_sort(F.collect_list(F.struct("_b", "_map"))).alias("_maps"))
    return maps.select(*by, "steps", F.aggregate("_maps", F.lit(float(start)), lambda x, m: fold.at(m["_map"], x)).alias("level"))


def level_series(df: DataFrame, by: list[str], order: list[str], bucket: Column, step: Column, fold: Fold, start: float, before: bool = False, name: str = "level") -> DataFrame:
    """(by, order, level) after each row, or ``before`` it.

    ``bucket`` rises with the order and holds some hundred rows. The levels at which buckets
    begin come from the maps of earlier ones, so no task walks a key's rows from the first.
    """
    held = _buckets(df, by, order, bucket, step, fold)
    maps = held.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_b", "_map"))).alias("_maps"))
    begun = _walked(F.transform("_maps", lambda m: m["_map"]), F.lit(float(start)), fold, True)
    starts = maps.select(*by, F.explode(F.arrays_zip(F.col("_maps")["_b"].alias("_b"), begun.alias("_x0"))).alias("_z")).select(*by, "_z._b", "_z._x0")
    rows = held.join(starts, [*by, "_b"])
    levels = _walked(F.transform("_xs", lambda x: x["_m"]), F.col("_x0"), fold, before)
    each = rows.select(*by, F.explode(F.arrays_zip(F.col("_xs").alias("x"), levels.alias("level"))).alias("_z"))
    return each.select(*by, *[F.col(f"_z.x.{o}").alias(o) for o in order], F.col("_z.level").alias(name))


#: Maps that one growing array of levels holds.
_RUN = 256


def _walked(maps: Column, start: Column, fold: Fold, before: bool) -> Column:
    """The level after each map (``before``: ahead of it), in proportion to the maps: runs of them begin at levels that the maps of earlier runs give."""
    double = F.array().cast("array<double>")

    def walk(run: Column, x: Column) -> Column:
        step = lambda s, m: F.struct(fold.at(m, s["x"]).alias("x"), F.concat(s["done"], F.array(s["x"] if before else fold.at(m, s["x"]))).alias("done"))
        return F.aggregate(run, F.struct(x.alias("x"), double.alias("done")), step, lambda s: s["done"])

    def of(all_maps: Column) -> Column:
        runs = F.when(F.size(all_maps) > 0, F.sequence(F.lit(0), F.floor((F.size(all_maps) - 1) / _RUN).cast("int"))).otherwise(F.array().cast("array<int>"))
        run = lambda k: F.slice(all_maps, k * _RUN + 1, F.lit(_RUN))
        whole = F.transform(runs, lambda k: F.aggregate(run(k), fold.identity, fold.then))
        first = F.aggregate(whole, F.struct(start.alias("x"), double.alias("done")), lambda s, m: F.struct(fold.at(m, s["x"]).alias("x"), F.concat(s["done"], F.array(s["x"])).alias("done")), lambda s: s["done"])
        return F.flatten(F.zip_with(runs, first, lambda k, x: walk(run(k), x)))

    return F.transform(F.array(maps), of)[0]


def clamped_total(df: DataFrame, by: list[str], order: list[str], step: Column, start: float, low: float, high: float, bucket: Column | None = None) -> DataFrame:
    """A running total clamped after every step: (by, steps, level) at the end; a map x to min(hi, max(lo, x + s)) stands for a bucket."""
    return last_level(df, by, order, F.lit(0) if bucket is None else bucket, clamp(step, low, high), clamps(), start)


def charge_step(power: Column, capacity: float, efficiency_in: float = 0.95, efficiency_out: float = 0.95, hours: float = 1 / 3600) -> Column:
    """Percent of charge that a step's power moves: charging (power < 0) and discharging lose differently."""
    return 100 * F.when(power < 0, -power * efficiency_in).otherwise(-power / efficiency_out) * hours / capacity


def charge_level(df: DataFrame, by: list[str], order: list[str], power: Column, capacity: float, start: float, low: float, high: float, efficiency_in: float = 0.95, efficiency_out: float = 0.95, idle: float = 0.0, hours: float = 1 / 3600, bucket: Column | None = None) -> DataFrame:
    """State of charge in percent at the end; ``idle`` is the energy a step leaks."""
    return clamped_total(df, by, order, charge_step(power, capacity, efficiency_in, efficiency_out, hours) - 100 * idle / capacity, start, low, high, bucket)


def smoothed(df: DataFrame, by: list[str], order: list[str], value: str, alpha: float, bucket: Column | None = None) -> DataFrame:
    """First-order smoothing y = (1 - alpha) y + alpha x from 0: its last value for each key."""
    step = affine(F.lit(1 - alpha), alpha * F.col(value))
    return last_level(df, by, order, F.lit(0) if bucket is None else bucket, step, affines(), 0.0).select(*by, F.col("level").alias("smoothed"))


def held_first(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "held") -> DataFrame:
    """The first value of each interval, held over it."""
    return df.withColumn(name, F.first_value(value).over(Window.partitionBy(*by).orderBy(*order)))


def phase(t: Column, start: Column, period: int, phases: int = 2) -> Column:
    return F.pmod(F.floor((t - start) / period), F.lit(phases))


def ramp_factor(t: Column, start: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (t - start) / seconds))).otherwise(F.lit(1.0))


def trapezoid(i: Column, n: Column) -> Column:
    """Ramp up, hold and ramp down, a third each: the factor of row i of n."""
    third = F.greatest(F.lit(1), F.floor(n / 3))
    return F.when(i < third, i / third).when(i < n - third, F.lit(1.0)).otherwise((n - i) / third)


def shifted(df: DataFrame, by: list[str], order: list[str], value: str, rows: int, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(value, rows).over(Window.partitionBy(*by).orderBy(*order)))


def tensor(df: DataFrame, t: str, order: str, value: str, width: int, stride: int, length: int | None = None) -> DataFrame:
    """The values of each window in order, as ``(window_id, steps array)``; a window is bounded by its width."""
    rows = hopping(df.select(t, order, value), t, width, stride, length)
    held = rows.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct(t, order, F.col(value).alias("_v")))).alias("_x"))
    return held.select("window_id", F.col("_x")["_v"].alias("steps"))


def best_of_each(df: DataFrame, by: str, key: str, order: list[Column], groups: list[str]) -> DataFrame:
    """The best row of each group in turn; a key that an earlier group took is out. One small job a group."""
    taken = None
    for group in groups:
        rows = df.filter(F.col(by) == group)
        rows = rows if taken is None else rows.join(taken.select(key), key, "left_anti")
        best = rows.orderBy(*order, key).limit(1).select(*df.columns)
        taken = best if taken is None else taken.unionByName(best)
    return taken
