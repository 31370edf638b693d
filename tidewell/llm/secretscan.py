"""Secret scans through an incremental blob ledger (native).

A version of a file is named by the SHA-256 of its content. The ledger holds a row for
each blob and rule version that has been scanned, with its findings; a scan reads only
pairs the ledger lacks, appends them, and joins the findings back to every path. Copies
cost one scan: they are combined map-side before the shuffle by blob.

Defined results: a null text is the empty blob; paths may repeat or be null (each row gets
the blob's findings); an empty table gives no rows; columns other than the path and the
text are not read. A rule's version must change with its pattern.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import SPAN, labelled, located
from .storage import shared_folder

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str
    #: Does a match count?
    keep: Callable[[Column], Column] | None = None

    @property
    def id(self) -> str:
        return f"{self.name}@{self.version}"

    def find(self, text: Column) -> Column:
        found = located(text, self.pattern)
        return found if self.keep is None else F.filter(found, lambda s: self.keep(s["match"]))


#: A shorter run never counts and its end is the longer one's too, so the lengths stand in the patterns of access and hex.
RULES = (
    Rule("assign", 1, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
    Rule("access", 1, "AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, "[0-9a-f]{32,}"),
)


def _ledger(spark, path: str) -> DataFrame:
    """The rows of the ledger; none where nothing has been written yet."""
    schema = f"blob string, rule string, spans {SPAN}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.sql(f"select cast(null as string) blob, cast(null as string) rule, cast(null as {SPAN}) spans where false")
    return spark.read.schema(schema).parquet(path)


def scan(versions: DataFrame, path: str = "doc_id", text: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, findings) for each row; findings is sorted by start, then by the rules' order.

    ``ledger`` is a folder all executors reach; without one, a new one in the shared folder.
    """
    spark = versions.sparkSession
    ledger = ledger or f"{shared_folder(spark)}/tidewell/ledger-{uuid.uuid4().hex}"
    content = F.coalesce(F.col(text), F.lit(""))
    named = versions.select(F.col(path).alias("path"), F.sha2(content, 256).alias("blob"), content.alias("text"))
    wanted = F.array(*[F.lit(r.id) for r in rules])
    seen = _ledger(spark, ledger).filter(F.col("rule").isin([r.id for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    blobs = named.groupBy("blob").agg(F.first("text").alias("text"))
    unseen = blobs.join(seen, "blob", "left").withColumn("due", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("due") > 0)
    none = F.array().cast(SPAN)
    rows = F.array(*[F.struct(F.lit(r.id).alias("rule"), F.when(F.array_contains("due", r.id), r.find(F.col("text"))).otherwise(none).alias("spans")) for r in rules])
    scanned = unseen.select("blob", "due", F.explode(rows).alias("r")).filter(F.array_contains("due", F.col("r.rule"))).select("blob", "r.rule", "r.spans")
    scanned.write.mode("append").parquet(ledger)

    known = _ledger(spark, ledger).filter(F.size("spans") > 0)
    each = [F.first(F.when(F.col("rule") == r.id, F.col("spans")), ignorenulls=True) for r in rules]
    by_blob = known.groupBy("blob").agg(*[x.alias(f"r{i}") for i, x in enumerate(each)])
    parts = [labelled(r.name, i, F.coalesce(f"r{i}", none)) for i, r in enumerate(rules)]
    found = by_blob.select("blob", F.array_sort(F.concat(*parts)).alias("findings"))
    empty = F.array().cast("array<struct<start:int,k:int,end:int,kind:string>>")
    out = versions.select(F.col(path).alias("path"), F.sha2(content, 256).alias("blob")).join(found, "blob", "left")
    return out.select("path", "blob", F.coalesce("findings", empty).alias("findings"))
