"""Sinks: tables, JSON lines, documents for viewers, and reports of small results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or for local masters without it in a temporary folder."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(where or tempfile.gettempdir()).rstrip('/')}/tidewell/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_aligned(df: DataFrame, path: str) -> None:
    """Append rows to a table by name; columns either side lacks read as NULL."""
    df.write.mode("append").parquet(path)


def read_aligned(spark, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str) -> None:
    """One column of text, a line a row."""
    df.write.mode("overwrite").text(path)


def write_text_files(df: DataFrame, path: str, by: tuple[str, str] = ("folder", "name"), text: str = "value") -> None:
    """Texts in files by two columns: ``path/folder=.../name=.../``; rows of one file are its lines.

    What takes time is the number of files, which adaptive execution doesn't see: it would leave small texts to one task, so
    the number of tasks is stated. In a folder that all mount (``file``), tasks write files themselves: Spark's writer runs
    ``chmod`` for each of them. Elsewhere Spark writes them, and each task moves its own (the committer's second algorithm).
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in by], text).repartition(tasks, *by)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    if root.getScheme() != "file":
        rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*by).text(path)
        return
    folder = root.getPath()

    def write(part) -> None:
        import itertools
        import os
        import re
        import uuid

        # as Spark escapes values in paths; a file stands under its name once it is whole, so that a task may run again
        safe = lambda v: re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", v or "") or "__HIVE_DEFAULT_PARTITION__"
        for key, same in itertools.groupby(part, lambda r: (r[0], r[1])):
            place = os.path.join(folder, *[f"{c}={safe(v)}" for c, v in zip(by, key, strict=True)])
            os.makedirs(place, exist_ok=True)
            made = os.path.join(place, f".{uuid.uuid4().hex}")
            with open(made, "w", encoding="utf-8", newline="") as out:
                out.writelines(f"{r[2] or ''}\n" for r in same)
            os.replace(made, os.path.join(place, "part-00000.txt"))

    rows.sortWithinPartitions(*by).foreachPartition(write)


def document(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*columns))


def xml_text(df: DataFrame, template: str, **values: Column) -> DataFrame:
    """A ``value`` column with each row's document; markup characters in values are escaped."""
    out: Column = F.lit(template)
    for name, value in values.items():
        safe = F.coalesce(value.cast("string"), F.lit(""))
        for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            safe = F.replace(safe, F.lit(raw), F.lit(escaped))
        out = F.replace(out, F.lit("{" + name + "}"), safe)
    return df.select(out.alias("value"))


def markdown_lines(order: str, columns: list[str]) -> Column:
    """A table of a group's rows as one text, as an aggregate: rows by ``order``, which must be few in a group."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), cells.alias("line")))), lambda x: x["line"])
    head = f"| {' | '.join(columns)} |\n|{' --- |' * len(columns)}\n"
    return F.concat(F.lit(head), F.array_join(rows, "\n"))


def markdown(df: DataFrame, most: int = 200) -> str:
    """A table of a small result; more than ``most`` rows are refused rather than cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds {most} rows; write a table instead")
    head = f"| {' | '.join(df.columns)} |\n|{' --- |' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in rows)
