"""Sessions, and shipping this package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(name: str = "tidewell", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and single machines; on a cluster, use the one you are given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once a session."""
    context = spark.sparkContext
    if getattr(context, "_tidewell_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidewell-")) / "tidewell_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in here.rglob("*.py"):
            archive.write(source, source.relative_to(here.parent))
    context.addPyFile(str(target))
    context._tidewell_shipped = True
