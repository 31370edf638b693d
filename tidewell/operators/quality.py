"""Data-quality checks: many predicates, one pass.

A check is an aggregate that counts violations; all checks on a table are columns of one
aggregation, turned into rows afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import Interval, covering


@dataclass(frozen=True)
class Check:
    name: str
    #: Number of violations, as an aggregate.
    violations: Column
    #: Outcome where there are violations.
    severity: str = "FAIL"


def row_count(expected: int, name: str = "row_count") -> Check:
    return Check(name, F.abs(F.count("*") - F.lit(expected)))


def no_duplicates(*keys: str, name: str | None = None) -> Check:
    return Check(name or f"unique_{'_'.join(keys)}", F.count("*") - F.count_distinct(F.struct(*keys)))


def no_nulls(column: str, name: str | None = None) -> Check:
    return Check(name or f"not_null_{column}", F.count_if(F.col(column).isNull()))


def in_range(column: str, low: float, high: float, severity: str = "FAIL", name: str | None = None) -> Check:
    return Check(name or f"range_{column}", F.count_if(~F.col(column).between(low, high)), severity)


def in_set(column: str, allowed: list, name: str | None = None) -> Check:
    return Check(name or f"enum_{column}", F.count_if(~F.col(column).isin(allowed)))


def implies(name: str, condition: Column, then: Column) -> Check:
    return Check(name, F.count_if(condition & ~F.coalesce(then, F.lit(False))))


def greater_mean(name: str, value: str, high: Column, low: Column) -> Check:
    """1 violation unless the mean where ``high`` holds exceeds the mean where ``low`` does."""
    return Check(name, F.when(F.avg(F.when(high, F.col(value))) > F.avg(F.when(low, F.col(value))), 0).otherwise(1), "WARN")


def run_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    """(check_name, violations, status)."""
    wide = df.agg(*[F.coalesce(c.violations.cast("long"), F.lit(0).cast("long")).alias(f"c{i}") for i, c in enumerate(checks)])
    rows = [F.struct(F.lit(c.name).alias("check_name"), F.col(f"c{i}").alias("violations"), F.when(F.col(f"c{i}") == 0, "PASS").otherwise(c.severity).alias("status")) for i, c in enumerate(checks)]
    return wide.select(F.inline(F.array(*rows)))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Decided on the schema, without a job."""
    return [c for c in required if c not in df.columns]


def first_present(df: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def gap_violations(df: DataFrame, t: str, step: int, by: list[str] | None = None) -> DataFrame:
    """(by, gaps): neighbours that are not ``step`` apart."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(t)
    return df.withColumn("_next", F.lead(t).over(w)).groupBy(*by).agg(F.count_if(F.col("_next") - F.col(t) != step).alias("gaps"))


def alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_a, only_b, both) of two tables' keys."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, key, "full_outer")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))


def rollup(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of outcomes, pass rate and overall: FAIL if any check fails, WARN if any warns."""
    made = results.groupBy(*(by or [])).agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "WARN", "FAIL")], F.count("*").alias("total"))
    overall = F.when(F.col("fail") > 0, "FAIL").when(F.col("warn") > 0, "WARN").otherwise("PASS")
    return made.withColumn("pass_rate", F.round(F.try_divide(F.col("pass"), F.col("total")), 6)).withColumn("overall", overall)


def has_columns(df: DataFrame, required: list[str]) -> list[Check]:
    """A check for each column that must be there, decided on the schema."""
    return [Check(f"has_{c}", F.max(F.lit(int(c not in df.columns)))) for c in required]


def equal_on(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(unmatched, unequal, first_key, last_key): keys on one side only, keys whose values differ, and the ends of ``a``."""
    left = a.select(F.col(key).alias("_l"), *[F.col(v).alias(f"_l{i}") for i, v in enumerate(values)])
    right = b.select(F.col(key).alias("_r"), *[F.col(v).alias(f"_r{i}") for i, v in enumerate(values)])
    joined = left.join(right, F.col("_l") == F.col("_r"), "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    differ = reduce(lambda x, y: x | y, [~F.col(f"_l{i}").eqNullSafe(F.col(f"_r{i}")) for i in range(len(values))])
    return joined.agg(F.count_if(~both).alias("unmatched"), F.count_if(both & differ).alias("unequal"), F.min("_l").alias("first_key"), F.max("_l").alias("last_key"))


def denied_names(features: DataFrame, words: list[str]) -> DataFrame:
    """(feature, word) of names that hold a denied word: one pass, no join."""
    found = F.filter(F.array(*map(F.lit, words)), lambda w: F.col("feature").contains(w))
    return features.select("feature", F.explode(found).alias("word"))


def physics_suite(df: DataFrame, site, rows: int, step: int, ends: tuple[str, str], required: list[str], methods: list[str]) -> DataFrame:
    """(check_name, violations, status) of telemetry, nearly all in one aggregation: axis, ends, columns, ratings, voltages and methods.

    ``site`` holds the ratings; checks on columns that the table lacks are left out, but for the ``required`` ones.
    """
    c = F.col
    over = lambda p, q, rated: F.count_if(F.hypot(c(p), c(q)) > rated + 0.5)
    starts = lambda best, text: F.when(best("timestamp_utc", "time_s").startswith(text), 0).otherwise(1)
    wanted = [
        (("time_s",), row_count(rows)), (("time_s",), no_duplicates("time_s")), (("timestamp_utc",), Check("start_timestamp", starts(F.min_by, ends[0]))), (("timestamp_utc",), Check("end_timestamp", starts(F.max_by, ends[1]))),
        (("pv_p_kw", "pv_available_kw"), Check("pv_not_exceed_available", F.count_if(c("pv_p_kw") > c("pv_available_kw") + 1.0))), (("pv_p_kw", "pv_q_kvar"), Check("pv_apparent_power_limit", over("pv_p_kw", "pv_q_kvar", site.pv_kva))),
        (("bess_p_kw", "bess_q_kvar"), Check("bess_apparent_power_limit", over("bess_p_kw", "bess_q_kvar", site.storage_kva))),
        (("bess_soc_percent",), in_range("bess_soc_percent", site.low_percent - 0.5, site.high_percent + 0.5, name="bess_soc_range")), (("pcc_v_a_pu",), in_range("pcc_v_a_pu", 0.85, 1.15, "WARN", "voltage_plausible")),
        (("pcc_voltage_unbalance_pu",), Check("voltage_unbalance", F.count_if(c("pcc_voltage_unbalance_pu") >= 0.020))), (("pv_s_rated_kva",), Check("no_generic_rating", F.count_if(c("pv_s_rated_kva").isin(500.0, 450.0 * 1.111)))),
        (("generation_method",), in_set("generation_method", methods, "methods_allowed")),
    ]
    checks = [check for columns, check in wanted if all(x in df.columns for x in columns)]
    made = run_checks(df, [*checks, *has_columns(df, required)])
    # a second that has rows, but whose next one has none
    held, following = df.select("time_s").distinct(), df.select((c("time_s") - step).alias("time_s")).distinct()
    lost = held.join(following, "time_s", "left_anti").agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("violations"))
    gaps = lost.select(F.lit("no_gaps").alias("check_name"), "violations", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status"))
    return made.unionByName(gaps)


def gates(results: DataFrame, by: list[str], only_warn: list[str]) -> DataFrame:
    """(by, overall, figure_warnings) over whole gates: any that failed fails all, but those that may ``only_warn``."""
    failed, soft = F.col("status") == "FAIL", F.col("gate").isin(only_warn)
    return results.groupBy(*by).agg(F.when(F.bool_or(failed & ~soft), "FAIL").otherwise("PASS").alias("overall"), F.count_if(failed & soft).alias("figure_warnings"))


def causality_suite(scenarios: DataFrame, log: DataFrame, key: str, seconds: int) -> DataFrame:
    """(check_name, violations, status): scenarios against their labels, times and the rows of their lifecycle log."""
    c = F.col
    checks = [
        no_duplicates(key), implies("command_before_effect", c("scenario_class") == "cyber_physical", c("command_apply_time_s") >= c("start_time_s")),
        implies("normal_is_unlabelled", c("scenario_class") == "normal", c("label") == 0), in_range("start_time_s", 0, seconds - 1), Check("ends_in_week", F.count_if(c("end_time_s") > seconds - 1), "WARN"),
    ]
    lost = scenarios.join(log.select(key).distinct(), key, "left_anti")
    return run_checks(scenarios, checks).unionByName(run_checks(lost, [Check("has_rows_for_each_scenario", F.count("*"))]))


def context_suite(ctx: DataFrame) -> DataFrame:
    """(check_name, violations, status) of context windows: columns that must be there, and what flags may not say; checks on absent columns are left out."""
    c, one = F.col, F.lit(1).cast("long")
    required = ["cyber_active_flag", "command_active_flag", "physical_effect_active_flag", "attack_active_flag", "generation_method", "protocol_claim_level"]
    of = lambda kind, flag: F.avg(F.when(c("final_event_class") == kind, (c(flag) == 1).cast("double")))
    early = (c("anomaly_type") == "delayed_pv_limit") & (c("physical_effect_active_flag") == 1) & ~F.coalesce(c("relative_time_to_apply_s") >= -5, F.lit(False))
    wanted = [
        (("attack_active_flag",), Check("attack_flag_not_all_rows", F.when(F.avg("attack_active_flag") >= 0.5, one), "WARN")), (("final_event_class", "physical_effect_active_flag"), Check("cyber_only_no_physical_flag", F.when(of("cyber_only", "physical_effect_active_flag") > 0, one), "WARN")),
        (("final_event_class", "cyber_active_flag"), Check("physical_only_no_malicious_cyber_flag", F.when(of("physical_only", "cyber_active_flag") >= 0.2, one), "WARN")), (("anomaly_type", "relative_time_to_apply_s", "physical_effect_active_flag"), Check("delayed_physical_after_apply_time", F.count_if(early))),
        *[((x,), Check(f"ctx_{x}_no_null", F.count_if(c(x).isNull()), "WARN")) for x in ("generation_method", "protocol_claim_level")], ((), Check("context_windows_not_empty", F.when(F.count("*") == 0, one))),
    ]
    return run_checks(ctx, [*has_columns(ctx, required), *[check for columns, check in wanted if all(x in ctx.columns for x in columns)]])


def alignment_suite(aligned: DataFrame, log: DataFrame, manifest: DataFrame, seconds: int, scenarios: int, authors: int, old_assets: list[str], bucket: int = 3600) -> DataFrame:
    """(check_name, violations, status) of a spine aligned with scenarios, from both sides.

    ``aligned`` (time_s, zero_day_active_flag, scenario_id, scenario_class, author_model, target_asset_id, cyber_anomaly_active,
    physical_effect_active, event_level_only, packet_level_protocol_compliance_claimed) is read in one pass; that
    its flags are those of the ``manifest``'s intervals (scenario_id, start_time_s, end_time_s, closed) is found by a sweep, which
    expands no interval. ``log`` and ``manifest`` meet by their ids.
    """
    c = F.col
    active = c("zero_day_active_flag") == 1
    single = active & (c("scenario_id") != "MULTIPLE")
    off = lambda kind, flag, value: F.count_if(single & (c("scenario_class") == kind) & ~F.coalesce(c(flag) == value, F.lit(False)))
    checks = [
        row_count(seconds), Check("time_s_min", F.abs(F.min("time_s"))), Check("time_s_max", F.abs(F.max("time_s") - (seconds - 1))), no_duplicates("time_s"),
        Check("authors_represented", F.greatest(F.lit(0).cast("long"), F.lit(authors) - F.count_distinct(F.when(active, c("author_model"))))), Check("old_assets", F.count_if(c("target_asset_id").isin(old_assets))),
        Check("event_level_only", F.count_if(c("event_level_only") == 0)), Check("packet_claims", F.count_if(c("packet_level_protocol_compliance_claimed") == 1)),
        Check("normal_without_cyber", off("normal", "cyber_anomaly_active", 0)), Check("normal_without_physical", off("normal", "physical_effect_active", 0)), Check("cyber_only_without_physical", off("cyber_only", "physical_effect_active", 0)),
        Check("physical_only_without_cyber", off("physical_only", "cyber_anomaly_active", 0)), Check("cyber_physical_with_cyber", off("cyber_physical", "cyber_anomaly_active", 1)), Check("cyber_physical_with_physical", off("cyber_physical", "physical_effect_active", 1)),
    ]
    swept = covering(aligned, "time_s", manifest, Interval("start_time_s", "end_time_s", True), bucket)
    sides = [Check("active_where_covered", F.count_if((c("covering") > 0) != F.coalesce(active, F.lit(False)))), Check("multiple_where_overlapping", F.count_if((c("covering") > 1) != F.coalesce(c("scenario_id") == "MULTIPLE", F.lit(False))))]
    ids = manifest.select("scenario_id").distinct()
    strange = log.select("scenario_id").distinct().join(ids, "scenario_id", "left_anti")
    seen = aligned.filter(active & (c("scenario_id") != "MULTIPLE")).select("scenario_id").distinct()
    unseen = ids.join(seen, "scenario_id", "left_anti")
    found = [run_checks(aligned, checks), run_checks(swept, sides), run_checks(strange, [Check("log_ids_in_manifest", F.count("*"))]), run_checks(ids, [Check("manifest_scenarios", F.abs(F.count("*") - scenarios), "WARN")]),
             run_checks(unseen, [Check("scenarios_represented", F.count("*"), "WARN")])]
    return reduce(DataFrame.unionByName, found)


def claim_case(rows: DataFrame, by: list[str], method: str, resolved: str, surrogate: str, allowed: list[str]) -> DataFrame:
    """(by, resolved_rows, surrogate_rows, unknown_methods, claim_case, status): what may be claimed of rows by how they came about.

    C: all of them resolved; B: some; A: none. Rows of other methods count for neither; methods outside ``allowed`` fail the group.
    """
    m = F.col(method)
    sums = rows.groupBy(*by).agg(F.count_if(m == resolved).alias("resolved_rows"), F.count_if(m == surrogate).alias("surrogate_rows"), F.count_distinct(F.when(~m.isin(allowed), m)).alias("unknown_methods"))
    case = F.when((F.col("resolved_rows") > 0) & (F.col("surrogate_rows") == 0), "C").when(F.col("resolved_rows") > 0, "B").otherwise("A")
    return sums.withColumns({"claim_case": case, "status": F.when(F.col("unknown_methods") > 0, "FAIL").otherwise("PASS")})


def file_checks(found: DataFrame, expected: DataFrame, name: str = "name", length: str = "length", least: str = "least", soft: str = "soft") -> DataFrame:
    """(name, exists, length, status) of expected files: one that is absent or shorter than its ``least`` bytes fails, or warns where it is ``soft``."""
    held = found.groupBy(name).agg(F.max(length).alias("_length"))
    joined = expected.join(held, name, "left")
    bad = F.col("_length").isNull() | (F.col("_length") < F.col(least))
    status = F.when(~bad, "PASS").when(F.col(soft), "WARN").otherwise("FAIL")
    return joined.select(name, F.col("_length").isNotNull().alias("exists"), F.coalesce("_length", F.lit(0)).alias("length"), status.alias("status"))
