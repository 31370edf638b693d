"""Scans: typed, column-pruned and tolerant of missing columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str | T.StructType, columns: list[str] | None = None, padded: bool = False) -> DataFrame:
    """A CSV scan with declared types; ``padded`` strips the spaces some exports put around fields and names."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True)
    if padded:
        reader = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    df = reader.csv(path)
    return df.select(*columns) if columns else df


def pick(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Those of the wanted columns that are there, in the order asked for."""
    return df.select(*[c for c in wanted if c in df.columns])


def first_available(df: DataFrame, candidates: list[str], name: str) -> DataFrame:
    """The first candidate column that exists, as ``name``; NULL if none does."""
    found = next((c for c in candidates if c in df.columns), None)
    return df.withColumn(name, F.col(found) if found else F.lit(None).cast("string"))


def numeric(column: str, fill: float = 0.0, kind: str = "float") -> Column:
    """Numbers out of whatever the column holds; what is no number becomes ``fill``."""
    return F.coalesce(F.col(column).try_cast("double"), F.lit(fill)).cast(kind)


def json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One document a file, found at any depth, with its path."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    return (reader.schema(schema) if schema else reader).json(path).withColumn("source_path", F.col("_metadata.file_path"))


def json_lines(spark: SparkSession, path: str, key: str, schema: str | None = None) -> DataFrame:
    """A row for each key: the one that stands last in its file, of files the last by path."""
    from pyspark.sql import Window

    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.json(path).withColumns({"_file": F.col("_metadata.file_path"), "_place": F.monotonically_increasing_id()})
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_file"), F.desc("_place")))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r", "_file", "_place")


def xml_documents(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).xml(path)


def xml_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A document a line, as ``sinks.xml_text`` makes them."""
    return spark.read.text(path).select(F.from_xml("value", schema).alias("_d")).select("_d.*")


def _binary(spark: SparkSession, path: str) -> DataFrame:
    """Files at any depth. They are listed here, by a few tasks a core; else each folder would be a task, for every folder above it."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    finally:
        spark.conf.set(key, before)


def files(spark: SparkSession, path: str, suffixes: list[str], skip: list[str] | None = None, content: bool = False) -> DataFrame:
    """(path, length, modificationTime[, content]) of files with a suffix, outside the folders to skip."""
    found = _binary(spark, path)
    if not content:
        found = found.drop("content")
    keep = F.lower("path").rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    for folder in skip or []:
        keep = keep & ~F.col("path").contains(f"/{folder}/")
    return found.filter(keep)


def fingerprints(spark: SparkSession, path: str, head: int = 4 << 20, most: int = 256 << 20) -> DataFrame:
    """(path, length, digest, status): SHA-256 of the first bytes of each file.

    A file is one value, so the content of those over ``most`` bytes is not read: they have no digest and are ``TOO_LARGE``.
    """
    found = _binary(spark, path)
    read = found.filter(F.col("length") <= most).select("path", "length", F.sha2(F.substring("content", 1, head), 256).alias("digest"), F.lit("OK").alias("status"))
    return read.unionByName(found.filter(F.col("length") > most).select("path", "length", F.lit(None).cast("string").alias("digest"), F.lit("TOO_LARGE").alias("status")))


def network_objects(lines: DataFrame, text: str = "value", order: str = "line", by: str = "source_path") -> DataFrame:
    """Objects of a network model script: a row for each ``key=value``, with the object it belongs to.

    A line that begins with ``New`` opens an object; ``~`` and ``More`` lines go on with it.
    """
    from pyspark.sql import Window

    clean = F.trim(F.regexp_replace(F.col(text), "!.*$", ""))
    rows = lines.withColumn("_t", clean).withColumn("_new", F.nullif(F.regexp_extract("_t", r"(?i)^new\s+(?:object=)?\"?([\w.]+)", 1), F.lit("")))
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("object", F.last("_new", True).over(w)).filter("object is not null")
    rows = rows.filter(F.col("_new").isNotNull() | F.col("_t").rlike(r"(?i)^(?:~|more\b)"))
    pairs = F.explode(F.regexp_extract_all("_t", F.lit(r"([\w%]+)\s*=\s*(\[[^\]]*\]|\([^)]*\)|\S+)"), F.lit(0)))
    return rows.select(by, "object", pairs.alias("_p")).select(by, "object", F.lower(F.trim(F.substring_index("_p", "=", 1))).alias("key"), F.trim(F.regexp_extract("_p", r"=\s*(.*)$", 1)).alias("value"))


def ratings(layers: DataFrame, order: list[str], by: list[str] | None = None, source: str = "source", key: str = "key", value: str = "value") -> DataFrame:
    """(by, key, value, source) of settings: of the sources in ``order``, the last one that has a value decides."""
    place = F.lit(None).cast("int")
    for i, name in enumerate(order):
        place = F.when(F.col(source) == name, i).otherwise(place)
    rows = layers.withColumn("_p", place).filter(F.col("_p").isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(*(by or []), key).agg(F.max_by(value, "_p").alias(value), F.max_by(source, "_p").alias(source))


def settings(lines: DataFrame, order: str, text: str = "value", by: str = "source_path") -> DataFrame:
    """(by, section, key, value) of YAML settings: ``key: value`` pairs and lists of plain values below sections of any depth.

    A section is the path of the keys above, joined by dots (NULL at the top); an item of a list has its place as key. Comments
    and quotes are dropped; lists of mappings, anchors and texts over several lines are not read. A file is one
    document, walked with a stack of its open sections.
    """
    from pyspark.sql import Window

    clean = F.regexp_replace(F.col(text), r"(^|\s)#.*$", "")
    pair, bare = r"^\s*([\w.%-]+):(?:\s+(.*?))?\s*$", r"^\s*-\s+(.*?)\s*$"
    plain = lambda x: F.regexp_replace(x, r"""^["']|["']$""", "")
    item = clean.rlike(bare)
    value = F.when(item, F.regexp_extract(clean, bare, 1)).otherwise(F.regexp_extract(clean, pair, 2))
    key = F.when(~item, F.regexp_extract(clean, pair, 1))
    line = F.struct(F.col(order).alias("place"), F.length(F.regexp_extract(clean, "^ *", 0)).alias("indent"), key.alias("key"), plain(value).alias("value"), (~item & (value == "")).alias("opens"))
    held = lines.filter(item | clean.rlike(pair)).groupBy(by).agg(F.array_sort(F.collect_list(line)).alias("_x"))
    place = dict(lines.dtypes)[order]
    stack, rows = F.array().cast("array<struct<indent:int,key:string>>"), F.array().cast(f"array<struct<place:{place},section:string,key:string,value:string>>")

    def step(s: Column, x: Column) -> Column:
        # an item may stand as far in as the key of its list
        above = F.filter(s["stack"], lambda e: (e["indent"] < x["indent"]) | (x["key"].isNull() & (e["indent"] == x["indent"])))
        section = F.array_join(F.transform(above, lambda e: e["key"]), ".")
        one = F.struct(x["place"].alias("place"), F.nullif(section, F.lit("")).alias("section"), x["key"].alias("key"), x["value"].alias("value"))
        return F.when(x["opens"], F.struct(F.concat(above, F.array(F.struct(x["indent"].alias("indent"), x["key"].alias("key")))).alias("stack"), s["rows"].alias("rows"))).otherwise(F.struct(above.alias("stack"), F.concat(s["rows"], F.array(one)).alias("rows")))

    found = held.select(by, F.inline(F.aggregate("_x", F.struct(stack.alias("stack"), rows.alias("rows")), step, lambda s: s["rows"])))
    nth = F.row_number().over(Window.partitionBy(by, "section", F.col("key").isNull()).orderBy("place")) - 1
    return found.select(by, "section", F.coalesce("key", nth.cast("string")).alias("key"), "value")


def classified(found: DataFrame, words: dict[str, list[str]], path: str = "path") -> DataFrame:
    """Files with the ``kind`` whose words their names hold (the first kind that does), or ``other``."""
    name, kind = F.lower(F.element_at(F.split(path, "/"), -1)), F.lit("other")
    for label, some in reversed(words.items()):
        for word in some:
            kind = F.when(name.contains(word), label).otherwise(kind)
    return found.withColumn("kind", kind)


def window_rows(windows: DataFrame, features: list[str], split: str | None = None, training: bool = False, kind: str = "double") -> DataFrame:
    """Windows as ``x`` (an array of the features) beside ``y`` and their other columns: of one split, or the clean and normal rows of training.

    Raises where nothing is left, as there is nothing to fit then.
    """
    rows = windows if split is None else windows.filter(F.col("split") == split)
    rows = rows.filter((F.col("source_dataset") == "clean") & (F.col("y") == 0)) if training else rows
    if training and rows.isEmpty():
        raise ValueError("no clean and normal window to train on")
    x = F.array(*[F.coalesce(F.col(f).cast(kind), F.lit(0.0).cast(kind)) for f in features])
    return rows.select(*[c for c in windows.columns if c not in features], x.alias("x"))
