"""Session settings the library is tuned for."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings that hold on a laptop and on a cluster alike.
COMMON = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot fund is split even where that costs one more shuffle behind the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Daily rows that meet a lookup of small partitions are hashed, not sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # A list of funds that is too long to broadcast becomes a Bloom filter at the scan of the daily rows.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "256MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", name: str = "cotaflow", memory: str = "8g", **extra: str) -> SparkSession:
    """A single-machine session.  On a cluster use the session the platform provides."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    partitions = "8" if cores == "*" else str(cores)
    settings = {
        **COMMON,
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": partitions,
        **{k.replace("__", "."): v for k, v in extra.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark



def tune(spark: SparkSession) -> None:
    """Give any session the settings above that can be changed while it runs, such as those for hot keys."""
    for key, value in COMMON.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, and keep Arrow batches small.

    Task functions can then import it whatever folder the driver was started in.  A batch of Spark's default
    of ten thousand rows is too much where rows are texts; another number that the user has set stays.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    context = spark.sparkContext
    if getattr(context, "_cotaflow_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="cotaflow-")) / "cotaflow_package.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for path in sorted(package.rglob("*.py")):
            target.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._cotaflow_shipped = True
