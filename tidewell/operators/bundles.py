"""Scenario bundles out of JSON documents of any shape: exploded, repaired, judged, counted.

A document is parsed to a VARIANT, so one that is broken, or that has a text where a number belongs,
is a row with a reported fault, never a NULL that passes for an absent field. A row for each scenario
carries its faults and repairs; what concerns a whole bundle (counts of classes, days, repeated ids) is
one partial aggregate by bundle. The work is column expressions; nothing is looped over on the driver.
The fields of an object leave its VARIANT in one cast, and what later rules read often is a column of a
step before them: a path or a kind asked for in each rule would build a VARIANT or a schema each time.

Defined results: a null or broken document is an ``invalid_json`` fault; a bundle without a required
field is judged for nothing else; a scenario that is not an object has a fault of its own and no fields;
an empty table gives no rows; two bundles of one name are one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import sinks
from .effects import ALIASES, BOUNDS

# Vocabularies of bundles, and the sentences they must hold.
ASSETS = {"der_site_001": "der_site", "pv_001": "pv", "bess_001": "bess", "pcc_001": "pcc"}
FORBIDDEN_ASSETS = ("pv35", "pv60", "pv83", "pv76", "pv49", "pv104", "pv114", "bess48", "bess76", "bess108", "bess114")
AUTHORS = ("chatgpt", "claude", "gemini", "grok", "other")
COMPONENTS = ("pv", "bess", "pcc", "measured_layer", "der_site")
CLASSES = {"normal": 4, "cyber_only": 4, "physical_only": 6, "cyber_physical": 2}
FAMILIES = (
    "normal_control_variation", "soc_aware_bess_dispatch_anomaly", "pv_curtailment_mismatch", "stale_or_delayed_measurement", "command_delay", "command_suppression",
    "oscillatory_bess_control", "pcc_voltage_deviation", "coordinated_pv_bess_response", "false_data_injection_context_only", "availability_degradation_context_only", "physical_irradiance_like_disturbance",
)
FORBIDDEN_WORDS = ("payload", "packet_bytes", "tcp_flags", "exploit", "malware", "credential", "password", "hash", "shellcode", "buffer_overflow", "sql_injection", "cve_id", "metasploit", "cobalt_strike")
FORBIDDEN_VARIABLES = ("temperature_c", "pcc_freq_hz", "frequency_hz", "grid_frequency", "bus_id", "ieee123_bus")
PURPOSE = "held_out_zero_day_like_frozen_model_evaluation"
COMPATIBILITY = "I used only the final single-site dataset assets der_site_001, pv_001, bess_001, pcc_001; I did not use old multi-DER asset IDs or packet-level cyber fields."
SAFETY_NOTE = "Synthetic/simulation-only defensive frozen-model evaluation scenario; no real-world telemetry or protocol compliance claim."
WEEK, DAY = 604_800, 86_400
PER_DAY = 4

_FAULT = "array<struct<rule:string,severity:string,detail:string>>"
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
_EFFECT = "variable", "effect_type", "unit", "direction", "shape"
_LABELS = "label_anomaly", "label_cyber_anomaly", "label_physical_anomaly"
_CLAIMS = "event_level_only", "packet_level_protocol_compliance_claimed"


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _of_kind(kind: Column, *kinds: str) -> Column:
    """Is it one of the kinds? False where there is none."""
    return F.coalesce(reduce(lambda a, k: a | kind.startswith(k), kinds[1:], kind.startswith(kinds[0])), F.lit(False))


def _is(v: Column, *kinds: str) -> Column:
    """Is the VARIANT of one of the kinds? False where it is absent."""
    return _of_kind(_kind(v), *kinds)


def _at(v: Column, name: str) -> Column:
    """The field as a VARIANT, NULL where there is none (a JSON null is one)."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def _struct(*names: str) -> str:
    return f"struct<{', '.join(f'{n}:variant' for n in names)}>"


def _fields(v: Column, *names: str) -> Column:
    """The fields in one cast, each as ``_at`` has it; NULL where the VARIANT is no object."""
    return F.try_variant_get(v, "$", _struct(*names))


def _text(v: Column, kind: Column | None = None) -> Column:
    """The VARIANT if it is a text, else NULL."""
    return F.when(_of_kind(_kind(v) if kind is None else kind, "STRING"), F.try_variant_get(v, "$", "string"))


def _number(v: Column, kind: Column | None = None) -> Column:
    return F.when(_of_kind(_kind(v) if kind is None else kind, *_NUMBERS), F.try_variant_get(v, "$", "double"))


def parsed(documents: DataFrame, bundle: str = "bundle_id", text: str = "doc") -> DataFrame:
    """(bundle, v): each document as a VARIANT, NULL where it is no JSON."""
    return documents.select(F.col(bundle).alias("bundle_id"), F.try_parse_json(F.col(text)).alias("v"))


def scenarios(bundles: DataFrame) -> DataFrame:
    """A row for each scenario of the parsed bundles, repaired: old names and missing fields filled, effect names and signs normalised.

    ``repairs`` lists what was done; ``faults`` the fields of a wrong kind, which read as NULL; ``claims`` has the VARIANTs of two fields of the context.
    """
    v = F.col("v")
    rows = bundles.select("bundle_id", _text(_at(v, "author_model")).alias("author_model"), F.posexplode(F.try_variant_get(v, "$.scenarios", "array<variant>")).alias("place", "s"))
    plain = ("scenario_id", "scenario_class", "scenario_family", "target_asset_id", "target_component", "start_time_s", "duration_s", "cyber_physical_type", "affected_asset", "scenario_name", "safety_note")
    s, f = F.col("s"), lambda name: F.col("f")[name]
    rows = rows.withColumn("f", _fields(s, *plain, "physical_effects", "cyber_context", "labels"))
    rows = rows.withColumns({
        **{f"_{c}": _kind(f(c)) for c in plain}, "_other": F.when(F.col("f").isNull(), F.to_json(s)), "claims": _fields(f("cyber_context"), *_CLAIMS), "_labels": _fields(f("labels"), *_LABELS),
        "_effects": F.try_variant_get(f("physical_effects"), "$", f"array<{_struct(*_EFFECT, 'magnitude', 'ramp_seconds')}>"),
    }).drop("s")
    here = lambda name: f(name).isNotNull()
    c = F.col
    rows = rows.withColumns({x: (_number if x in ("start_time_s", "duration_s") else _text)(f(x), c(f"_{x}")) for x in plain} | {x: _number(c("_labels")[x]) for x in _LABELS})
    of_kind = lambda name, *kinds: _of_kind(F.col(f"_{name}"), *kinds)
    whole = F.col("f").isNotNull()
    asset = F.when(here("target_asset_id"), c("target_asset_id")).otherwise(c("affected_asset"))
    component = F.lit("der_site")
    for known, kind in ASSETS.items():
        component = F.when(asset == known, kind).otherwise(component)
    name = F.coalesce("scenario_id", F.lit("?"))
    read = F.transform(F.coalesce("_effects", F.array().cast(f"array<{_struct(*_EFFECT, 'magnitude', 'ramp_seconds')}>")), lambda e: F.struct(*[_text(e[c]).alias(c) for c in _EFFECT], _number(e["magnitude"]).alias("magnitude"), F.coalesce(_number(e["ramp_seconds"]).cast("long"), F.lit(0)).alias("ramp_seconds"), e.isNotNull().alias("whole")))
    right = {**{x: of_kind(x, "STRING") for x in plain[:5]}, **{x: of_kind(x, *_NUMBERS) for x in plain[5:7]}, "physical_effects": c("_effects").isNotNull(), "cyber_context": c("claims").isNotNull(), "labels": c("_labels").isNotNull()}
    wrong = [F.when(~whole, _fault("type_scenario", c("_other"))), *[F.when(here(x) & ~ok, _fault(f"type_{x}", F.to_json(f(x)))) for x, ok in right.items()]]
    rows = rows.select(
        "bundle_id", "author_model", "place", whole.alias("whole"), "scenario_id",
        F.when(here("scenario_name"), c("scenario_name")).otherwise(F.replace(name, F.lit("_"), F.lit(" "))).alias("scenario_name"),
        "scenario_family", F.when(here("scenario_class"), c("scenario_class")).otherwise(c("cyber_physical_type")).alias("scenario_class"),
        asset.alias("target_asset_id"), F.when(here("target_component"), c("target_component")).otherwise(component).alias("target_component"),
        "start_time_s", "duration_s", (of_kind("start_time_s", "BIGINT") & of_kind("duration_s", "BIGINT")).alias("whole_seconds"),
        F.when(here("safety_note"), c("safety_note")).otherwise(F.lit(SAFETY_NOTE)).alias("safety_note"),
        *_LABELS, F.to_json(f("cyber_context")).alias("cyber_context"), "claims",
        read.alias("read"), F.array_compact(F.array(*wrong)).cast(_FAULT).alias("faults"),
        *[here(x).alias(f"_{x}") for x in ("scenario_class", "cyber_physical_type", "target_asset_id", "affected_asset", "scenario_name", "target_component", "safety_note")],
    )
    lowered = lambda e: (e["magnitude"] < 0) & e["direction"].isin("increase", "decrease")
    done = {
        "alias_scenario_class": ~F.col("_scenario_class") & F.col("_cyber_physical_type"), "alias_target_asset_id": ~F.col("_target_asset_id") & F.col("_affected_asset"),
        "generated_scenario_name": ~F.col("_scenario_name"), "inferred_target_component": ~F.col("_target_component"), "default_safety_note": ~F.col("_safety_note"),
    }
    log = F.array_compact(F.array(*[F.when(c & F.col("whole"), n) for n, c in done.items()]))
    of_effects = F.transform(F.filter("read", lambda e: F.coalesce(e["effect_type"].isin(*ALIASES), F.lit(False))), lambda e: F.concat(F.lit("effect_type_"), e["effect_type"]))
    of_signs = F.transform(F.filter("read", lambda e: F.coalesce(lowered(e), F.lit(False))), lambda e: F.lit("negative_magnitude"))

    def mended(e: Column) -> Column:
        named = e["effect_type"]
        for old, new in ALIASES.items():
            named = F.when(e["effect_type"] == old, new).otherwise(named)
        return e.withField("effect_type", named).withField("magnitude", F.when(lowered(e), -e["magnitude"]).otherwise(e["magnitude"]))

    rows = rows.withColumns({"repairs": F.concat(log, of_effects, of_signs), "physical_effects": F.transform("read", mended)})
    return rows.drop("read", *[c for c in rows.columns if c.startswith("_")])


def _fault(rule: str, detail: Column, severity: str = "ERROR") -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.coalesce(detail.cast("string"), F.lit("missing")).alias("detail"))


def _broken(rules: list[tuple]) -> Column:
    """Faults of the rules (name, condition, detail[, severity]) that hold; an unknown condition counts as broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(r[1], F.lit(True)), _fault(r[0], r[2], *r[3:])) for r in rules])).cast(_FAULT)


def _has_word(text: Column) -> Column:
    return reduce(lambda a, w: a | text.contains(w), FORBIDDEN_WORDS[1:], text.contains(FORBIDDEN_WORDS[0]))


def judged_scenarios(rows: DataFrame) -> DataFrame:
    """Scenario rows with all their ``faults``."""
    c = F.col
    n, kind = F.size("physical_effects"), c("scenario_class")
    labels, (events, packets) = [c(x) for x in _LABELS], [c("claims")[x] for x in _CLAIMS]
    rows = rows.withColumns({"_pattern": c("scenario_id").rlike(r"^zdl_(chatgpt|claude|gemini|grok|other)_[a-z0-9_]+_[0-9]{3}$"), "_context": F.lower("cyber_context")})
    pattern = c("_pattern")
    end = c("start_time_s") + c("duration_s") - 1
    false = F.lit(False)
    is_true = lambda v: F.coalesce(F.try_variant_get(v, "$", "boolean"), false) & _is(v, "BOOLEAN")
    is_false = lambda v: ~F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(True)) & _is(v, "BOOLEAN")
    of_kind = lambda *k: F.coalesce(kind.isin(*k), false)
    rules = [
        ("id_pattern", ~pattern, c("scenario_id")), ("id_author", F.coalesce(pattern & (c("author_model") != "") & (F.regexp_extract("scenario_id", r"^zdl_([a-z]+)_", 1) != c("author_model")), false), c("scenario_id")),
        ("class", ~kind.isin(*CLASSES), kind), ("family", ~c("scenario_family").isin(*FAMILIES), c("scenario_family")),
        ("forbidden_asset", F.coalesce(c("target_asset_id").isin(*FORBIDDEN_ASSETS), false), c("target_asset_id")), ("asset", ~c("target_asset_id").isin(*ASSETS, *FORBIDDEN_ASSETS), c("target_asset_id")),
        ("component", ~c("target_component").isin(*COMPONENTS), c("target_component")), ("start_range", ~c("start_time_s").between(0, WEEK - 1), c("start_time_s")), ("duration_range", ~c("duration_s").between(60, 1800), c("duration_s")),
        ("end_range", c("whole_seconds") & (end >= WEEK), end),
        *[(f"missing_{name}", c(name).isNull(), F.lit(None).cast("string")) for name in _LABELS],
        ("cyber_only_effects", of_kind("cyber_only") & (n > 0), n), ("normal_effects", of_kind("normal") & (n > 0), n),
        ("normal_labels", of_kind("normal") & ~F.coalesce((labels[0] == 0) & (labels[1] == 0) & (labels[2] == 0), false), F.concat_ws(",", *[x.cast("int").cast("string") for x in labels])),
        ("physical_without_effects", of_kind("physical_only", "cyber_physical") & (n == 0), kind),
        ("event_level_only", ~is_true(events), F.to_json(events)), ("packet_claim", ~is_false(packets), F.to_json(packets)),
        ("forbidden_word", F.coalesce(_has_word(c("_context")), false), c("cyber_context")),
    ]

    def of_effect(e: Column) -> Column:
        span = F.lit(None).cast("double")
        for variable, (low, high) in BOUNDS.items():
            span = F.when(e["variable"] == variable, high - low).otherwise(span)
        known = F.coalesce(e["variable"].isin(*BOUNDS), false)
        forbidden = F.coalesce(e["variable"].isin(*FORBIDDEN_VARIABLES), false)
        wide = F.coalesce(F.abs(e["magnitude"]) > span, false)
        return _broken([
            ("type_effect", ~e["whole"], F.lit("effect")), ("forbidden_variable", forbidden, e["variable"]), ("variable", ~known & ~forbidden, e["variable"]),
            ("irradiance_family", F.coalesce(e["variable"] == "irradiance_pu", false) & ~F.coalesce(c("scenario_family") == "physical_irradiance_like_disturbance", false), c("scenario_family")), ("magnitude_bounds", wide, e["magnitude"], "WARN"),
        ])

    own = F.when(c("whole"), F.concat(_broken(rules), F.flatten(F.transform("physical_effects", of_effect)))).otherwise(F.array().cast(_FAULT))
    return rows.withColumn("faults", F.concat("faults", own)).drop("_pattern", "_context")


def judged(bundles: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """A row for each bundle: its own ``faults``, how many ``errors``, ``warnings``, ``repairs`` and ``scenarios`` it has, and its ``status``.

    ``rows`` are its judged scenarios, made here where not given. Days are judged only where nothing else is wrong.
    """
    rows = judged_scenarios(scenarios(bundles)) if rows is None else rows
    v = F.col("v")
    top = ("dataset_id", "author_model", "generation_purpose", "project_compatibility_statement", "compatibility_statement")
    f = lambda name: F.col("f")[name]
    # an array casts to one, whatever its elements are; the scenarios themselves are not read here
    bundles = bundles.withColumns({"f": _fields(v, *top), "listed": F.try_variant_get(v, "$.scenarios", "array<boolean>").isNotNull()})
    said = F.when(f(top[3]).isNotNull(), _text(f(top[3]))).otherwise(_text(f(top[4])))
    renamed = f(top[3]).isNull() & f(top[4]).isNotNull()
    whole, there = F.col("f").isNotNull(), F.col("listed") | _at(v, "scenarios").isNotNull()
    lacking = [(f"missing_{name}", f(name).isNull(), F.lit(None).cast("string")) for name in top[:3]]
    lacking += [("missing_project_compatibility_statement", f(top[3]).isNull() & f(top[4]).isNull(), F.lit(None).cast("string")), ("missing_scenarios", ~there, F.lit(None).cast("string")),
                ("type_scenarios", ~F.col("listed") & there, _kind(_at(v, "scenarios")))]
    first = F.when(v.isNull(), F.array(_fault("invalid_json", F.lit(None))).cast(_FAULT)).when(~whole, F.array(_fault("type_bundle", _kind(v))).cast(_FAULT)).otherwise(_broken(lacking))
    own = bundles.select("bundle_id", first.alias("first"), _text(f("author_model")).alias("author_model"), _text(f("generation_purpose")).alias("purpose"), said.alias("said"), (whole & renamed).alias("renamed"))
    of = lambda severity: F.size(F.filter("faults", lambda x: x["severity"] == severity))
    day = F.floor(F.col("start_time_s") / DAY)
    counts = rows.select("bundle_id", "scenario_id", "scenario_class", day.alias("day"), of("ERROR").alias("bad"), of("WARN").alias("warned"), F.size("repairs").alias("mended"))
    sums = counts.groupBy("bundle_id").agg(
        F.count(F.lit(1)).alias("scenarios"), *[F.sum(x).alias(x) for x in ("bad", "warned", "mended")],
        (F.count("scenario_id") - F.count_distinct("scenario_id")).alias("again"), *[F.count_if(F.col("scenario_class") == k).alias(f"_{k}") for k in CLASSES], *[F.count_if(F.col("day") == d).alias(f"_day{d}") for d in range(7)],
    )
    counted = [c for c in sums.columns if c != "bundle_id"]
    both = own.join(sums, "bundle_id", "left").fillna(0, counted)
    c = F.col
    rules = [
        ("author_model", ~c("author_model").isin(*AUTHORS), c("author_model")), ("generation_purpose", c("purpose") != PURPOSE, c("purpose")), ("compatibility_statement", c("said") != COMPATIBILITY, F.substring("said", 1, 80)),
        ("scenario_count", c("scenarios") != sum(CLASSES.values()), c("scenarios")), ("unique_id", c("again") > 0, c("again")), *[(f"count_{k}", c(f"_{k}") != need, c(f"_{k}")) for k, need in CLASSES.items()],
    ]
    complete = F.size("first") == 0
    both = both.withColumn("faults", F.when(complete, _broken(rules)).otherwise(c("first")))
    both = both.withColumns({x: F.when(complete, c(x)).otherwise(0) for x in ("bad", "warned")})
    days = _broken([(f"day_{d + 1}", ~c(f"_day{d}").between(1, PER_DAY), c(f"_day{d}")) for d in range(7)])
    both = both.withColumn("faults", F.when((F.size("faults") == 0) & (c("bad") == 0), days).otherwise(c("faults")))
    errors = F.size("faults") + c("bad")
    return both.select("bundle_id", "author_model", "scenarios", "faults", errors.cast("long").alias("errors"), c("warned").cast("long").alias("warnings"), (c("mended") + c("renamed").cast("long")).cast("long").alias("repairs"),
                       F.when(errors == 0, "ACCEPTED").otherwise("REJECTED").alias("status"), complete.alias("complete"))


def violations(bundles: DataFrame) -> DataFrame:
    """(bundle_id, place, scenario_id, rule, severity, detail); place is NULL for what concerns the whole bundle.

    Scenarios of a bundle that lacks a required field are not judged.
    """
    spark, path = bundles.sparkSession, sinks.scratch(bundles.sparkSession, "judged")
    # judged once: the bundles' sums and the scenarios' own faults both read the table
    sinks.write_table(judged_scenarios(scenarios(bundles)).select("bundle_id", "place", "scenario_id", "scenario_class", "start_time_s", "repairs", "faults"), path)
    rows = spark.read.parquet(path)
    whole = judged(bundles, rows)
    of_bundles = whole.select("bundle_id", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("scenario_id"), F.inline("faults"))
    of_rows = rows.join(whole.filter("complete").select("bundle_id"), "bundle_id", "left_semi").select("bundle_id", "place", "scenario_id", F.inline("faults"))
    return of_bundles.unionByName(of_rows)


def counters(rows: DataFrame) -> DataFrame:
    """(bundle_id, dimension, value, n): scenarios by class, family, asset and day, effects by variable, of each bundle and (bundle_id NULL) of all.

    One pass: a row gives one key a dimension, and the grouping sets are expanded after the map-side sum.
    """
    day = F.when(F.col("start_time_s").between(0, WEEK - 1), F.concat(F.lit("day_"), (F.floor(F.col("start_time_s") / DAY) + 1).cast("string")))
    key = lambda name, value: F.struct(F.lit(name).alias("dimension"), F.coalesce(value, F.lit("?")).alias("value"))
    of_row = F.array(key("class", F.col("scenario_class")), key("family", F.col("scenario_family")), key("asset", F.col("target_asset_id")), *[key("day", day)])
    of_effects = F.transform("physical_effects", lambda e: key("variable", e["variable"]))
    keys = rows.select("bundle_id", F.inline(F.filter(F.concat(of_row, of_effects), lambda k: (k["dimension"] != "day") | (k["value"] != "?"))))
    each = keys.groupBy("bundle_id", "dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    sets = [[F.col("bundle_id"), F.col("dimension"), F.col("value")], [F.col("dimension"), F.col("value")]]
    return each.groupingSets(sets, "bundle_id", "dimension", "value").agg(F.sum("n").alias("n"))


def accepted(bundles: DataFrame) -> DataFrame:
    """(bundle_id, doc): accepted bundles with their repaired scenarios as JSON again."""
    rows = scenarios(bundles)
    whole = judged(bundles, judged_scenarios(rows)).filter("status = 'ACCEPTED'").select("bundle_id")
    effect = lambda e: F.struct(*[e[c].alias(c) for c in (*_EFFECT, "magnitude", "ramp_seconds")])
    fields = ("scenario_id", "scenario_name", "scenario_family", "scenario_class", "target_asset_id", "target_component", "safety_note")
    scenario = F.struct("place", *fields, F.col("start_time_s").cast("long").alias("start_time_s"), F.col("duration_s").cast("long").alias("duration_s"), F.transform("physical_effects", effect).alias("physical_effects"), F.try_parse_json("cyber_context").alias("cyber_context"),
                        F.struct(*[F.col(c).cast("int").alias(c) for c in _LABELS]).alias("labels"))
    held = rows.groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct("place", F.to_json(scenario.dropFields("place")).alias("s")))).alias("all"))
    v = F.col("v")
    top = F.to_json(F.struct(*[_text(_at(v, c)).alias(c) for c in ("dataset_id", "author_model", "generation_purpose")], F.lit(COMPATIBILITY).alias("project_compatibility_statement")))
    doc = F.concat(F.substr(top, F.lit(1), F.length(top) - 1), F.lit(',"scenarios":['), F.array_join(F.transform("all", lambda x: x["s"]), ","), F.lit("]}"))
    return bundles.join(whole, "bundle_id").join(held, "bundle_id").select("bundle_id", doc.alias("doc"))
