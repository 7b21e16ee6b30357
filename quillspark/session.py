"""One session for tools and tests: UTC, adaptive plans, few partitions for small data."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "quillspark", cores: str | int = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    builder = SparkSession.builder.appName(name).master(f"local[{cores}]").config("spark.driver.memory", memory)
    for key, value in {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context, so that their Python finds it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_quillspark_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quillspark-")) / "quillspark_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent).as_posix())
    context.addPyFile(str(target))
    context._quillspark_shipped = True
