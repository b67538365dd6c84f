"""What a Spark session needs before Python functions of this package run on its executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors' Python import this package: Spark's own file server hands out an archive of it, once a session."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sijill-")  # stays until the end, as it is served from there
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/{package.name}.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(f"{folder}/{package.name}.zip")


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the folder that the session or its context names.

    Where neither names one a temporary folder is set, but only on a local master: elsewhere each machine would write to its own disk.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sijill-"))
    return df.checkpoint()
