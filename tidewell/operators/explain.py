"""Evidence packets, rubric scores and records for charts and viewers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import json_object_text
from .intervals import Interval, inside, overlap_seconds

#: What an explanation must not claim, as whole words, each under its penalty; names of assets that are gone; fields of the glossary; expected timings.
PENALTIES = {
    "packet_claim_flag": r"(?i)\b(?:packets?|ieee\s*2030\.5|modbus|dnp3|mqtt|payloads?|frames?|bytes?|registers?|protocol traces?)\b",
    "field_telemetry_claim_flag": r"(?i)\b(?:real\s+field|live\s+measurements?|actual\s+telemetry|real\s+telemetry|real\s+sensors?)\b",
    "external_attacker_claim_flag": r"(?i)\b(?:hackers?|malware|exploit(?:s|ed)?|attackers?|threat\s+actors?|nation[\s-]states?|ransomware|apt\s*\d+)\b",
}
OLD_ASSETS = ("pv35", "pv60", "pv83", "bess48", "bess108")
ASSETS = ("der_site_001", "pv_001", "bess_001", "pcc_001")
GLOSSARY = (
    "pv_p_kw", "pv_q_kvar", "bess_p_kw", "bess_q_kvar", "bess_soc_percent", "pcc_v_a_pu", "pcc_v_b_pu", "pcc_v_c_pu", "pcc_i_a_amp", "pcc_i_b_amp", "pcc_i_c_amp", "pcc_p_kw", "pcc_q_kvar", "irradiance_pu", "temperature_c",
    "cyber_state", "cyber_lifecycle_stage", "cyber_anomaly_active", "physical_effect_active", "command_created_flag", "command_sent_flag", "command_recv_flag", "command_accept_flag", "command_apply_flag",
    "command_response_flag", "blocked_flag", "replay_flag", "mismatch_flag", "stale_command_flag", "timeout_flag", "command_apply_time_s", "physical_effect_start_time_s",
)
CYBER_WORDS = ("blocked_flag", "mismatch_flag", "replay_flag", "timeout_flag", "stale_command_flag", "command_apply_flag", "cyber_state")
TIMINGS = {
    "normal": ("no_anomaly",), "physical_only": ("physical_only_no_cyber_event",), "cyber_only": ("cyber_only_no_physical_effect",),
    "cyber_physical": ("cyber_before_physical_confirmed", "cyber_physical_simultaneous", "cyber_physical_timing_unknown"),
}
TIMING_WORDS = {
    "normal": ("normal", "no anomaly", "no event"), "physical_only": ("physical", "no cyber", "without cyber"), "cyber_only": ("cyber", "no physical", "not physical"),
    "cyber_physical": ("before", "coincide", "preceded", "followed", "cyber"),
}


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _by_class(kind: Column, cases: dict[str, Column], default: Column) -> Column:
    out = default
    for name, value in cases.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def penalties(text: Column, reported: dict[str, Column] | None = None) -> dict[str, Column]:
    """0/1 of each claim that the text makes or the answer reports of itself (``reported``, by the flag's name)."""
    found = {name: text.rlike(p) for name, p in PENALTIES.items()} | {"uses_old_asset_name_flag": _any(text, OLD_ASSETS), "unsupported_claim_flag": F.lit(False)}
    for name, said in (reported or {}).items():
        found[name] = found[name] | said
    return {name: F.coalesce(x, F.lit(False)).cast("int") for name, x in found.items()}


def positive_checks(kind: Column, asset: Column, component: Column, signals: Column, answer: dict[str, Column], text: Column, parsed: Column) -> dict[str, Column]:
    """The ten checks of an explanation against what is true of its detection.

    kind, asset, component, signals (array): the scenario's; answer: ``type, asset, signals (array), fields
    (array), cyber (array), timing_status, difference, timing, actions (array)`` of the explanation; text: all
    of it in lower case. What did not parse meets no check that applies.
    """
    none = F.array().cast("array<string>")
    lists = {k: F.coalesce(answer[k], none) for k in ("signals", "fields", "cyber", "actions")}
    named, done = F.coalesce(answer["asset"], F.lit("")), F.lower(F.array_join(lists["actions"], " "))
    physical, cyber = kind.isin("physical_only", "cyber_physical"), kind.isin("cyber_only", "cyber_physical")
    used = F.concat(lists["fields"], lists["signals"], lists["cyber"])
    glossary = F.array(*map(F.lit, GLOSSARY))
    timing = F.lower(F.coalesce(answer["timing"], F.lit("")))
    made = {
        "scenario_class_match": parsed & (answer["type"] == kind),
        "asset_match": parsed & ((named == asset) | named.contains(component) | named.contains(asset) | named.isin(*ASSETS)),
        "physical_signal_match": ~physical | (parsed & F.arrays_overlap(F.coalesce(signals, none), F.concat(lists["signals"], lists["fields"]))),
        "cyber_state_match": ~cyber | (parsed & ((F.size(lists["cyber"]) > 0) | _any(text, CYBER_WORDS))),
        "timing_match": parsed & _by_class(kind, {k: answer["timing_status"].isin(*v) for k, v in TIMINGS.items()}, F.lit(True)),
        "expected_vs_observed_match": parsed & (F.length(F.trim(answer["difference"])) > 30),
        "glossary_field_usage_correct": parsed & F.arrays_overlap(used, glossary),
        "explanation_mentions_evidence_fields": parsed & _any(text, GLOSSARY),
        "timing_relationship_correct": parsed & _by_class(kind, {k: _any(timing, v) for k, v in TIMING_WORDS.items()}, F.lit(False)),
        "operator_action_relevance": parsed & F.when(kind == "normal", F.size(lists["actions"]) == 0).otherwise(done.contains(component) | done.contains(asset)),
    }
    return {k: F.coalesce(v, F.lit(False)).cast("int") for k, v in made.items()}


def cyber_evidence(detections: DataFrame, aligned: DataFrame, flags: list[str], bucket: int, state: str = "cyber_state", stage: str = "cyber_lifecycle_stage", active: str = "cyber_anomaly_active") -> DataFrame:
    """States and stages seen in each detection's window, and each flag's share and whether it was ever up."""
    rows = inside(aligned.select("time_s", state, stage, active, *flags), "time_s", detections.select("detection_id", "window_start_s", "window_end_s"), Interval("window_start_s", "window_end_s", True), bucket)
    made = [x for f in flags for x in (F.round(F.avg(f), 4).alias(f"{f}_fraction"), (F.max(f) > 0).alias(f"{f}_seen"))]
    sums = rows.groupBy("detection_id").agg(F.array_sort(F.collect_set(state)).alias("cyber_states_seen"), F.array_sort(F.collect_set(stage)).alias("lifecycle_stages_seen"), F.round(F.avg(active), 4).alias("cyber_fraction"), *made)
    out = detections.select("detection_id").join(sums, "detection_id", "left")
    return out.withColumn("cyber_evidence_available", F.col("cyber_fraction").isNotNull())


def compact(signals: DataFrame, cyber: DataFrame, flags: list[str], top: int = 4, key: str = "detection_id") -> DataFrame:
    """(key, signals, active_flags): what fits a short prompt - the names of the ``top`` signals, best first, and of the flags that were ever up."""
    best = signals.filter(F.col("rank") <= top).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "signal"))), lambda x: x["signal"]).alias("signals"))
    up = cyber.select(key, F.array_compact(F.array(*[F.when(F.col(f"{f}_seen"), F.lit(f)) for f in flags])).alias("active_flags"))
    none = F.array().cast("array<string>")
    return up.join(best, key, "left").select(key, F.coalesce("signals", none).alias("signals"), F.coalesce("active_flags", none).alias("active_flags"))


#: The sentences of expected and observed behaviour by class.
DIFFERENCES = {
    "normal": ("Expected normal — no significant deviation observed.", "No anomaly. Normal monitoring."),
    "physical_only": ("Expected physical change with no cyber cause.", "Physical effect active without preceding cyber event."),
    "cyber_only": ("Expected cyber anomaly with no physical signal change.", "Cyber flags active but no physical effect."),
    "cyber_physical": ("Expected cyber event followed by physical signal change.", "Cyber event preceded or coincided with physical effect."),
}


def expected_and_observed(kind: Column, physical: Column, cyber: Column, top: Column) -> dict[str, Column]:
    """What was seen (shares of the window over a tenth, the most variable signal: struct signal, mean, std, delta), and what that says beside the class."""
    share = lambda name, x: F.when(F.coalesce(x, F.lit(0.0)) > 0.1, F.concat(F.lit(f"{name} active "), F.round(100 * x, 0).cast("int").cast("string"), F.lit("% of window.")))
    most = F.when(top.isNotNull(), F.concat(F.lit("Most variable physical signal: "), top["signal"], F.lit(" (mean="), top["mean"].cast("string"), F.lit(", std="), top["std"].cast("string"), F.lit(", delta="), top["delta"].cast("string"), F.lit(").")))
    seen = F.concat_ws(" ", share("Physical effect", physical), share("Cyber anomaly", cyber), most)
    none = F.lit("")
    return {
        "observed_behavior_summary": F.when(seen == "", "No significant deviation observed.").otherwise(seen),
        "expected_vs_observed_difference": _by_class(kind, {k: F.lit(v[0]) for k, v in DIFFERENCES.items()}, none),
        "timing_relationship_observed": _by_class(kind, {k: F.lit(v[1]) for k, v in DIFFERENCES.items()}, none),
    }


def alignment_status(kind: Column, applied: Column, effect: Column) -> Column:
    """What the command's application and the effect's start say of a detection, by class; times may be NULL."""
    both = F.when(applied <= effect, "cyber_before_physical_confirmed").when(applied > effect, "cyber_physical_simultaneous").otherwise("cyber_physical_timing_unknown")
    return _by_class(kind, {k: F.lit(v[0]) for k, v in TIMINGS.items() if len(v) == 1} | {"cyber_physical": both}, F.lit("unknown"))


def overall_score(checks: list[Column], faults: list[Column], parsed: Column, weight: float = 0.15, digits: int = 6) -> Column:
    """Mean of the checks less a weight for each penalty, inside [0, 1]; 0 for what did not parse."""
    mean = sum(checks[1:], checks[0]) / len(checks)
    less = weight * sum(faults[1:], faults[0]) if faults else F.lit(0.0)
    return F.round(F.when(parsed, F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean - less))).otherwise(0.0), digits)


def score_matrix(rows: DataFrame, by: list[str], checks: list[str], faults: list[str], parsed: str, digits: int = 6) -> DataFrame:
    """(by, n, the mean of each check and fault, parse_rate, mean_score): a heat map of checks; the score is the mean over what parsed, NULL where nothing did."""
    score = overall_score([F.col(c) for c in checks], [F.col(c) for c in faults], F.col(parsed), digits=12)
    means = [F.round(F.avg(c), digits).alias(c) for c in (*checks, *faults)]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *means, F.round(F.avg(F.col(parsed).cast("int")), digits).alias("parse_rate"), F.round(F.avg(F.when(F.col(parsed), score)), digits).alias("mean_score"))


def signal_evidence(detections: DataFrame, telemetry: DataFrame, signals: list[str], bucket: int, top: int = 6, threshold: float = 0.01, order: str | None = None) -> DataFrame:
    """The ``top`` signals by spread inside each detection's window, with their statistics and direction.

    detections: detection_id, window_start_s, window_end_s; telemetry: time_s, the signals and ``order``, a column that
    no two rows of a second share. The first and last value are of the first and last second that has one; of
    several rows there, the least by ``order`` counts, or without it the least value.
    """
    held, tie = ([], lambda s: s) if order is None else ([F.col(order).alias("_order")], lambda s: "_order")
    end = lambda s, time: F.min_by(s, F.when(F.col(s).isNotNull(), F.struct(time, tie(s))))
    rows = inside(telemetry.select("time_s", *signals, *held), "time_s", detections.select("detection_id", "window_start_s", "window_end_s"), Interval("window_start_s", "window_end_s", True), bucket)
    made = [x for s in signals for x in (F.min(s).alias(f"{s}|min"), F.max(s).alias(f"{s}|max"), F.avg(s).alias(f"{s}|mean"), F.stddev_samp(s).alias(f"{s}|std"), end(s, F.col("time_s")).alias(f"{s}|first"), end(s, -F.col("time_s")).alias(f"{s}|last"))]
    wide = rows.groupBy("detection_id").agg(F.count("*").alias("points"), *made)
    each = F.array(*[F.struct(F.lit(s).alias("signal"), *[F.col(f"`{s}|{m}`").alias(m) for m in ("min", "max", "mean", "std", "first", "last")]) for s in signals])
    long = wide.select("detection_id", "points", F.inline(each)).withColumn("delta", F.col("last") - F.col("first"))
    long = long.withColumn("direction", F.when(F.col("delta") > threshold, "increase").when(F.col("delta") < -threshold, "decrease").otherwise("stable"))
    rank = F.row_number().over(Window.partitionBy("detection_id").orderBy(F.desc_nulls_last("std"), "signal"))
    return long.withColumn("rank", rank).filter(F.col("rank") <= top)


def timing(detections: DataFrame, scenarios: DataFrame, key: str) -> DataFrame:
    """Seconds a detection shares with its scenario (both ends inclusive), and what that says."""
    joined = detections.join(scenarios, key, "left")
    shared = overlap_seconds(F.col("window_start_s"), F.col("window_end_s"), F.col("start_time_s"), F.col("end_time_s"))
    status = F.when(F.col("start_time_s").isNull(), "timing_unknown").when(F.col("shared_s") > 0, "overlapping").otherwise("disjoint")
    return joined.withColumn("shared_s", shared).withColumn("timing_status", status)


def parsed(answers: DataFrame, schema: str, answer: str = "answer") -> DataFrame:
    """``parsed`` (NULL where the outermost object is no JSON of the schema) and parse_success."""
    text = json_object_text(F.col(answer))
    # from_json makes a struct of NULLs out of broken text, so whether it is JSON is asked first
    sound = F.try_parse_json(text).isNotNull()
    return answers.withColumn("parsed", F.when(sound, F.from_json(text, schema))).withColumn("parse_success", F.coalesce(sound & F.col("parsed").isNotNull(), F.lit(False)))


def filled(template: str, values: dict[str, Column]) -> Column:
    """``{{name}}`` in a template replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def series(df: DataFrame, by: list[str], t: str, values: list[str]) -> DataFrame:
    """Parallel arrays in order of ``t`` for each key, as a viewer reads them. Keys must be bounded (downsample first)."""
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(t, *values))).alias("_x"))
    return rows.select(*by, *[F.col("_x")[c].alias(c) for c in (t, *values)])


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """(by, bin, n) of equal bins over [low, high); the last bin holds ``high`` too."""
    rows = df.filter(F.col(value).between(low, high))
    place = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / F.lit((high - low) / bins)))
    return rows.groupBy(*(by or []), place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def padded(start: Column, end: Column, duration: Column, least: int = 600, share: float = 1.5, last: int = 604_799) -> tuple[Column, Column]:
    """A slice around an interval for a chart, inside [0, last]."""
    pad = F.greatest(F.lit(least), (share * duration).cast("long"))
    return F.greatest(F.lit(0), start - pad), F.least(F.lit(last), end + pad)


def scorecard(score: Column, good: float = 0.8, fair: float = 0.5) -> dict[str, Column]:
    """A score as a whole percent and a level; NULL stays NULL."""
    return {"percent": F.round(score * 100).cast("long"), "level": F.when(score >= good, "good").when(score >= fair, "fair").when(score.isNotNull(), "poor")}


def packets(detections: DataFrame, signals: DataFrame, cyber: DataFrame, key: str = "detection_id") -> DataFrame:
    """(key, packet): one nested JSON document of a detection, its signals (best first), its cyber evidence and what both say."""
    top = signals.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "signal", "mean", "std", "delta", "direction", "points"))).alias("_signals"))
    about, rest = [c for c in detections.columns], [c for c in cyber.columns if c != key]
    joined = detections.join(top, key, "left").join(cyber, key, "left")
    first = F.get("_signals", F.lit(0))
    said = expected_and_observed(F.col("scenario_class"), F.lit(0.0), F.col("cyber_fraction"), F.when(first.isNotNull(), F.struct(first["signal"].alias("signal"), first["mean"].alias("mean"), first["std"].alias("std"), first["delta"].alias("delta"))))
    body = F.struct(F.struct(*about).alias("detection"), F.coalesce("_signals", F.array().cast("array<struct<rank:int,signal:string,mean:double,std:double,delta:double,direction:string,points:bigint>>")).alias("physical_evidence"), F.struct(*rest).alias("cyber_evidence"), F.struct(*[x.alias(n) for n, x in said.items()]).alias("expected_vs_actual"))
    return joined.select(key, F.to_json(body).alias("packet"))
