"""Where intermediate files may go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    A session without that setting uses a folder below its warehouse, which is shared wherever tables
    are, and keeps it in the setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_given: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses, with its file system spelled out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    _given.add(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path that ``scratch_path`` gave, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _given.discard(path)


def release(spark: SparkSession) -> None:
    """Delete all that this process has staged.  For when no DataFrame that reads it is needed any more."""
    for path in list(_given):
        discard(spark, path)


class Staging:
    """Tables a computation writes for itself, deleted when the block that made them ends.

    Use it around work whose result is written or counted inside the block::

        with Staging(spark) as stage:
            years = stage(fund_years, "fund-years")
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(path := scratch_path(self.spark, label))
        return written(df, path)

    def drop(self) -> None:
        while self.paths:
            discard(self.spark, self.paths.pop())

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` as Parquet and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Worth it where a small table that is dear to compute, such as fund-years, feeds several steps: the
    daily rows are read once, a lost executor costs nothing, and the size checks see its real size.
    Lazy plans may read the files later, so they stay until ``release``; ``Staging`` deletes its own.
    """
    return written(df, scratch_path(df.sparkSession, label))
