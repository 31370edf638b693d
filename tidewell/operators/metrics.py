"""Detection metrics as aggregates and window sums; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .intervals import settled


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def confusion(truth: Column, predicted: Column) -> list[Column]:
    cases = {"tp": truth & predicted, "fp": ~truth & predicted, "tn": ~truth & ~predicted, "fn": truth & ~predicted}
    return [F.count_if(c).alias(name) for name, c in cases.items()]


def rates(counts: DataFrame, digits: int = 6) -> DataFrame:
    """Precision, recall, F1, accuracy and balanced accuracy beside tp, fp, tn and fn."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    made = {
        "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn), "balanced_accuracy": (_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2,
    }
    return counts.withColumns({k: F.round(v, digits) for k, v in made.items()})


def evaluate(scores: DataFrame, by: list[str], truth: Column, predicted: Column, both_classes: bool = False) -> DataFrame:
    """Rates of each group; with ``both_classes`` a group that holds one class only has counts, but no rates."""
    rated = rates(scores.groupBy(*by).agg(*confusion(truth, predicted)))
    if not both_classes:
        return rated
    able = (F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0)
    return rated.withColumns({c: F.when(able, F.col(c)) for c in ("precision", "recall", "f1", "accuracy", "balanced_accuracy")})


def at_thresholds(scores: DataFrame, thresholds: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """Counts at each threshold of a small table (threshold), from one pass over the scores.

    Rows are summed by how many thresholds they reach, so a row is never paired with a threshold.
    """
    kept = sorted((r["threshold"] for r in thresholds.select("threshold").distinct().collect()), key=lambda t: (t is None, t or 0.0))
    steps = F.array(*[F.lit(t).cast("double") for t in kept])
    reached = F.size(F.filter(steps, lambda t: t <= F.col(score))).alias("_i")
    cells = scores.groupBy(reached).agg(F.sum(y).alias("_p"), F.count("*").alias("_n"))
    rows = cells.select("_i", "_p", "_n", F.posexplode(steps).alias("_j", "threshold"))
    above = F.col("_i") > F.col("_j")
    p, n = F.col("_p"), F.col("_n") - F.col("_p")
    zero = F.lit(0)
    counts = rows.groupBy("threshold").agg(
        F.sum(F.when(above, p).otherwise(zero)).alias("tp"), F.sum(F.when(above, n).otherwise(zero)).alias("fp"),
        F.sum(F.when(above, zero).otherwise(n)).alias("tn"), F.sum(F.when(above, zero).otherwise(p)).alias("fn"),
    )
    return rates(counts)


#: Rows around the ranks asked for below which their distinct values are fetched at once.
REST = 100_000


def exact_percentiles(df: DataFrame, columns: list[str], percents: list[float], bins: int = 4096) -> dict[str, list[float | None]]:
    """Percentiles of each column, linear between ranks; NULL and NaN are left out."""
    pairs = F.array(*[F.struct(F.struct(F.lit(c).alias("f")).alias("g"), F.col(c).cast("double").alias("v")) for c in columns])
    found = {g["f"]: q for g, q in _percentiles(df.select(F.inline(pairs)), percents, bins)}
    return {c: found.get(c, [None] * len(percents)) for c in columns}


def percentiles_by(df: DataFrame, by: list[str], value: str, percents: list[float], bins: int = 4096) -> DataFrame:
    """(by, percentiles) of each group that has values; groups are few, of any size."""
    found = _percentiles(df.select(F.struct(*by).alias("g"), F.col(value).cast("double").alias("v")), percents, bins)
    schema = T.StructType([*[df.schema[k] for k in by], T.StructField("percentiles", T.ArrayType(T.DoubleType()))])
    return df.sparkSession.createDataFrame([(*g, q) for g, q in found], schema)


def _place(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Which of equal bins from ``low`` to ``high`` holds v; where these can't be split evenly, the ends stand apart."""
    half = high / 2 - low / 2
    even = (half > 0) & (half < float("inf"))
    return F.when(even, F.least(F.lit(bins - 1), F.floor((v / 2 - low / 2) / half * bins))).otherwise(F.when(v == low, 0).when(v == high, bins - 1).otherwise(1))


def _percentiles(long: DataFrame, percents: list[float], bins: int) -> list[tuple]:
    """(g, percentiles) of (g, v).

    No task holds a group: each pass counts the bins of the intervals that hold a rank asked for, with
    the bins' extremes, which are the next pass's intervals; so an outlier costs one more pass. The
    driver sees bins, and distinct values once at most ``REST`` rows are left in the intervals.
    """
    rows = long.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    sums = [F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")]
    bounds = rows.groupBy("g").agg(*sums).collect()
    wanted = {r["g"]: sorted({k for p in percents for k in _ranks(p, r["n"])}) for r in bounds}
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("g", long.schema["g"].dataType), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
    todo, found = [(r["g"], r["low"], r["high"], 0, r["n"]) for r in bounds], {}
    while True:
        left = []
        for g, low, high, before, n in todo:
            hit = [k for k in wanted[g] if before <= k < before + n]
            if low == high:
                found.update({(g, k): low for k in hit})
            elif hit:
                left.append((g, low, high, before, n))
        if not left:
            break
        cells = long.sparkSession.createDataFrame([(i, *c[:3]) for i, c in enumerate(left)], schema)
        v = F.col("v")
        part = v if sum(c[4] for c in left) <= REST else _place(v, F.col("low"), F.col("high"), bins)
        # the cells are as few as the groups: they go to the rows, which a join by group would bring to a task a group
        inside = rows.join(F.broadcast(cells), "g").filter(v.between(F.col("low"), F.col("high")))
        todo, before = [], [c[3] for c in left]
        for r in sorted(inside.groupBy("i", part.alias("part")).agg(*sums).collect(), key=lambda r: (r["i"], r["low"])):
            todo.append((left[r["i"]][0], r["low"], r["high"], before[r["i"]], r["n"]))
            before[r["i"]] += r["n"]
    return [(r["g"], [_between(found, r["g"], p, r["n"]) for p in percents]) for r in bounds]


def _ranks(percent: float, n: int) -> tuple[int, int]:
    low = int(percent / 100 * (n - 1))
    return low, min(n - 1, low + 1)


def _between(found: dict, group, percent: float, n: int) -> float:
    low, high = _ranks(percent, n)
    share = percent / 100 * (n - 1) - low
    if not share:  # what lies above may be infinite
        return found[group, low]
    return found[group, low] + (found[group, high] - found[group, low]) * share


def percentile_thresholds(scores: DataFrame, score: str, percents: list[float]) -> DataFrame:
    """(percent, threshold): exact percentiles, linear between ranks."""
    found = exact_percentiles(scores, [score], percents)[score]
    rows = F.array(*[F.struct(F.lit(float(p)).alias("percent"), F.lit(t).cast("double").alias("threshold")) for p, t in zip(percents, found, strict=True)])
    return scores.sparkSession.range(1).select(F.inline(rows))


def choose_threshold(scores: DataFrame, percents: list[float], score: str = "score", y: str = "y", fallback: float = 95.0) -> DataFrame:
    """The percentile threshold with the best F1, the first of equals; the ``fallback`` percentile without positives."""
    thresholds = percentile_thresholds(scores, score, sorted({*percents, fallback}))
    swept = thresholds.join(at_thresholds(scores, thresholds, score, y), "threshold")
    some = (F.col("tp") + F.col("fn")) > 0
    tried = F.col("percent").isin([float(p) for p in percents])
    rank = F.when(some & tried, F.struct((-F.col("f1")).alias("a"), F.col("percent").alias("b"))).when(~some & (F.col("percent") == fallback), F.struct(F.lit(0.0).alias("a"), F.col("percent").alias("b")))
    return swept.withColumn("_rank", rank).filter("_rank is not null").orderBy("_rank").limit(1).drop("_rank")


def _by_score(scores: DataFrame, by: list[str], score: str, y: str) -> DataFrame:
    """Distinct scores of each group with their positives and negatives."""
    return scores.filter(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*by, score).agg(F.sum(y).alias("p"), (F.count("*") - F.sum(y)).alias("n"))


def _joined(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns a table has for their keys; NULL is a key like others."""
    other = table.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return rows.join(other, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).drop(*[f"_k_{k}" for k in keys])


def _running(rows: DataFrame, by: list[str], score: str, sums: list[str], down: bool = False, bins: int = 256) -> DataFrame:
    """Distinct scores with the sums of those before (``_before_*``) and of all of their group (``_all_*``).

    Scores fall in bins between their group's extremes, and in bins between their bin's extremes. Only
    scores of one of these are sorted together, and only the table of bins is summed by group. Bins come
    from exact extremes, so a task that runs again finds the same ones.
    """
    v = F.col(score).cast("double")
    # written: every pass below reads the distinct scores, not what they were made from
    keys, placed = list(by), settled(rows, "scores")
    for name in ("_a", "_b"):
        ends = placed.groupBy(*keys).agg(F.min(v).alias("_low"), F.max(v).alias("_high"))
        placed = _joined(placed, ends, keys).withColumn(name, _place(v, F.col("_low"), F.col("_high"), bins)).drop("_low", "_high")
        keys.append(name)
    turn = F.desc if down else F.asc
    every = Window.partitionBy(*by)
    earlier = every.orderBy(turn("_a"), turn("_b")).rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    cells = cells.select(*keys, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums], *[F.sum(c).over(every).alias(f"_all_{c}") for c in sums])
    within = Window.partitionBy(*keys).orderBy(turn(score)).rowsBetween(Window.unboundedPreceding, -1)
    made = {f"_before_{c}": F.col(f"_before_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}
    return _joined(placed, cells, keys).withColumns(made).drop("_a", "_b")


def roc_auc(scores: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """(by, positives, negatives, roc_auc): ties count half; NULL with one class only."""
    below = _running(_by_score(scores, by, score, y), by, score, ["n"])
    sums = below.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum(F.col("p") * (F.col("_before_n") + F.col("n") / 2)).alias("wins"))
    return sums.select(*by, "positives", "negatives", F.round(F.try_divide("wins", F.col("positives") * F.col("negatives")), 6).alias("roc_auc"))


def curve(scores: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """Cumulative tp and fp at each distinct score, from the highest down, with tpr, fpr and precision."""
    rows = _running(_by_score(scores, by, score, y), by, score, ["p", "n"], down=True)
    rows = rows.withColumns({"tp": F.col("_before_p") + F.col("p"), "fp": F.col("_before_n") + F.col("n")})
    return rows.select(*by, score, "tp", "fp", F.try_divide("tp", "_all_p").alias("tpr"), F.try_divide("fp", "_all_n").alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def average_precision(scores: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """(by, average_precision): recall steps times precision, without interpolation."""
    rows = _running(_by_score(scores, by, score, y), by, score, ["p", "n"], down=True)
    tp = F.col("_before_p") + F.col("p")
    part = F.try_divide("p", "_all_p") * tp / (tp + F.col("_before_n") + F.col("n"))
    return rows.groupBy(*by).agg(F.round(F.sum(part), 6).alias("average_precision"))


def unseen_groups(test: DataFrame, seen: DataFrame, group: str, background: list[str] | None = None) -> DataFrame:
    """Test rows of groups the other table does not have (background groups left out); all rows if there are none."""
    known = seen.select(group).distinct()
    rows = test.filter(~F.col(group).isin(background)) if background else test
    new = rows.join(known, group, "left_anti")
    return rows if new.limit(1).count() == 0 else new


def recompute_audit(saved: DataFrame, recomputed: DataFrame, key: str, columns: list[str], tolerance: float = 1e-4) -> DataFrame:
    """A row for each key and column: both values, their difference and PASS, FAIL or MISSING."""
    a = saved.select(key, F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("metric", "saved"))
    b = recomputed.select(key, F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("metric", "recomputed"))
    both = a.join(b, [key, "metric"], "full_outer").withColumn("difference", F.abs(F.col("saved") - F.col("recomputed")))
    return both.withColumn("status", F.when(F.col("difference").isNull(), "MISSING").when(F.col("difference") > tolerance, "FAIL").otherwise("PASS"))


def verdict(counts: Column, complete: int, partial: int) -> Column:
    return F.when(counts >= complete, "COMPLETE").when(counts >= partial, "PARTIAL").otherwise("INCOMPLETE")


def class_confusion(rows: DataFrame, truth: str, predicted: str, classes: list[str], unknown: str = "unknown") -> DataFrame:
    """A row for each true class with a count for each predicted one; names outside ``classes`` count as unknown."""
    known = lambda c: F.when(F.col(c).isin(classes), F.col(c)).otherwise(unknown)
    made = rows.select(known(truth).alias("truth"), known(predicted).alias("_p"))
    return made.groupBy("truth").agg(*[F.count_if(F.col("_p") == c).alias(c) for c in (*classes, unknown)])


def summary(rows: DataFrame, by: list[str], value: str, digits: int = 6) -> DataFrame:
    """Mean, median, extremes and zeros of a value, such as a latency."""
    v = F.col(value)
    made = rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(v), digits).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.count_if(v == 0).alias("zeros"))
    median = percentiles_by(rows, by, value, [50]).select(*[F.col(k).alias(f"_k_{k}") for k in by], F.col("percentiles")[0].alias("median"))
    joined = made.join(median, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by], "left")
    return joined.select(*by, "n", "mean", "median", "low", "high", "zeros")


def best_configuration(scores: DataFrame, config: str, order: str, score: str = "score", y: str = "y", percents: tuple[float, ...] = (80, 90, 95)) -> DataFrame:
    """Of each configuration its best percentile threshold by F1, and of these the best; the first of equals."""
    cuts = percentiles_by(scores, [config, order], score, list(percents)).select(config, order, F.posexplode("percentiles").alias("_i", "threshold"))
    counts = scores.select(config, score, y).join(F.broadcast(cuts), config).groupBy(config, order, "_i", "threshold").agg(*confusion(F.col(y) == 1, F.col(score) >= F.col("threshold")))
    return rates(counts).orderBy(F.desc("f1"), order, "_i").limit(1).drop("_i")
