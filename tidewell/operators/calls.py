"""Calls of a text client over a table of prompts, with one repair that the parse decides, and a ledger of answers.

A call is named by the SHA-256 of model and prompt: equal prompts are called once, and answers are appended to a ledger, a
table in a folder that all executors reach. A run that ends early, or a second one, calls only what the ledger lacks.
An answer is parsed where the plan runs, not in the client's worker: what holds no JSON object is asked for
once more, under a name of its own in a second table of the ledger. Failures of the client are statuses, never exceptions.

Defined results: without a client every row is ``SKIPPED_LLM_NOT_READY``; a null prompt is called like the empty text; repeated
prompts share their answer; an empty table calls nothing; columns of the prompts pass through, but one with a result's name gives way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import json_object_text
from ..session import ship
from ..sources.sinks import scratch

#: What is asked after an answer without an object.
REPAIR = "The previous response was not valid JSON. Return ONLY one valid JSON object of the schema. No markdown, no explanation outside JSON."
_LEDGER = "call string, answer string, error string"
#: Fields of an explanation, and its types.
TYPES = ("normal", "physical_only", "cyber_only", "cyber_physical", "insufficient_evidence")
TEXTS = {"confidence": "low", "primary_asset": "", "expected_vs_observed_summary": "", "timing_summary": "", "operator_summary": "", "human_explanation": ""}
LISTS = ("primary_physical_signals", "primary_cyber_evidence", "recommended_operator_checks", "evidence_used", "evidence_missing")
CLAIMS = ("unsupported_claims_made", "packet_level_claim_made", "field_telemetry_claim_made", "external_attacker_claim_made", "old_asset_name_used")


def _called(unseen: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """(call, text) to the ledger's rows, where the rows are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for text in batch["text"]:
                try:
                    answers.append(client(text))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - any failure of the client is a status
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"call": batch["call"], "answer": answers, "error": errors})

    return unseen.mapInPandas(run, _LEDGER)


def _ledger(spark, path: str) -> DataFrame:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(path)


def _answered(wanted: DataFrame, client: Callable[[str], str], ledger: str, at_once: int) -> DataFrame:
    """The ledger's row of each call of ``wanted(call, text)``; those it lacks are made, ``at_once`` of them side by side.

    Calls that failed are in the ledger too, and are made again by another run.
    """
    spark = wanted.sparkSession
    done = _ledger(spark, ledger).filter("error is null").select("call")
    unseen = wanted.groupBy("call").agg(F.first("text").alias("text")).join(done, "call", "left_anti").repartition(at_once, "call")
    _called(unseen, client).write.mode("append").parquet(ledger)
    # of a call that failed before and was answered now, the answer counts
    return _ledger(spark, ledger).groupBy("call").agg(F.max("answer").alias("answer"), F.max("error").alias("error"))


def explanation(answer: Column) -> Column:
    """The object in an answer with all fields of an explanation, absent ones at their defaults; NULL without an object."""
    # worked out once, however many fields are read
    return F.transform(F.array(F.try_parse_json(json_object_text(answer))), _fields)[0]


def _fields(v: Column) -> Column:
    kind = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit(""))
    text = lambda name: F.when(kind(name) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))
    listed = lambda name: F.when(kind(name).startswith("ARRAY"), F.try_variant_get(v, f"$.{name}", "array<string>")).when(kind(name) == "STRING", F.array(text(name)))
    none = F.array().cast("array<string>")
    fields = [F.when(text("explanation_type").isin(*TYPES), text("explanation_type")).otherwise("insufficient_evidence").alias("explanation_type")]
    fields += [F.coalesce(text(name), F.lit(default)).alias(name) for name, default in TEXTS.items()]
    fields += [F.coalesce(listed(name), none).alias(name) for name in LISTS]
    fields += [F.coalesce(F.when(kind(name) == "BOOLEAN", F.try_variant_get(v, f"$.{name}", "boolean")), F.lit(False)).alias(name) for name in CLAIMS]
    return F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), F.struct(*fields))


def explanations(prompts: DataFrame, client: Callable[[str], str] | None, prompt: str = "prompt", model: str = "none", ledger: str | None = None, repair: str = REPAIR, at_once: int = 8) -> DataFrame:
    """``prompts`` with parse_status, error, answer (of the last call) and parsed (see ``explanation``).

    ``parse_status``: OK, OK_REPAIRED, FAILED (no object after the repair), FAILED_CALL_ERROR, FAILED_REPAIR_CALL_ERROR, SKIPPED_LLM_NOT_READY.
    """
    spark = prompts.sparkSession
    kept = [c for c in prompts.columns if c not in ("parse_status", "error", "answer", "parsed")]
    if client is None:
        nothing = F.lit(None).cast("string")
        return prompts.select(*kept, F.lit("SKIPPED_LLM_NOT_READY").alias("parse_status"), nothing.alias("error"), nothing.alias("answer"), explanation(nothing).alias("parsed"))
    ship(spark)
    ledger = ledger or scratch(spark, "calls")
    asked = F.coalesce(F.col(prompt), F.lit(""))
    again = F.concat(asked, F.lit("\n"), F.lit(repair))
    name = lambda text: F.sha2(F.concat(F.lit(model), F.lit("\n"), text), 256)
    rows = prompts.select(*kept, name(asked).alias("_first"), name(again).alias("_second"), asked.alias("_asked"), again.alias("_again"))
    one = _answered(rows.select(F.col("_first").alias("call"), F.col("_asked").alias("text")), client, f"{ledger}/asked", at_once)
    one = one.select(F.col("call").alias("_first"), F.col("answer").alias("_a1"), F.col("error").alias("_e1"))
    first = rows.join(one, "_first").withColumn("_p1", explanation(F.col("_a1")))
    broken = first.filter("_a1 is not null and _p1 is null")
    two = _answered(broken.select(F.col("_second").alias("call"), F.col("_again").alias("text")), client, f"{ledger}/repaired", at_once)
    two = two.select(F.col("call").alias("_second"), F.col("answer").alias("_a2"), F.col("error").alias("_e2"))
    both = first.withColumn("_second", F.when(F.col("_a1").isNotNull() & F.col("_p1").isNull(), F.col("_second"))).join(two, "_second", "left").withColumn("_p2", explanation(F.col("_a2")))
    status = (
        F.when(F.col("_a1").isNull(), "FAILED_CALL_ERROR").when(F.col("_p1").isNotNull(), "OK").when(F.col("_a2").isNull(), "FAILED_REPAIR_CALL_ERROR")
        .when(F.col("_p2").isNotNull(), "OK_REPAIRED").otherwise("FAILED")
    )
    error = F.when(F.col("_a1").isNull(), F.col("_e1")).when(F.col("_p1").isNull() & F.col("_a2").isNull(), F.col("_e2"))
    return both.select(*kept, status.alias("parse_status"), error.alias("error"), F.coalesce("_a2", "_a1").alias("answer"), F.coalesce("_p1", "_p2").alias("parsed"))
