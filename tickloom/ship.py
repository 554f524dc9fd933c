"""Makes the package importable in Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_tickloom_shipped", False):
        return
    top = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "tickloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(str(archive))
    context._tickloom_shipped = True


def in_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with the package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def by_group(df: DataFrame, keys: list[str], run: Callable, schema: str) -> DataFrame:
    """applyInPandas by group with the package at hand in the workers."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(run, schema)


def by_group_in_arrow(df: DataFrame, keys: list[str], run: Callable, schema: str) -> DataFrame:
    """applyInArrow by group with the package at hand in the workers; `run` takes and gives iterators of record batches."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(run, schema)
