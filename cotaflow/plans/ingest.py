"""From a landing folder of archives and text files to the consolidated daily table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotaflow.plans.base import MONTH_PARTITION, YEAR_PARTITION
from cotaflow.sources.archives import read_archives
from cotaflow.sources.delimited import read_delimited, union_by_name
from cotaflow.sources.files import any_match
from cotaflow.sources.schemas import DAILY_TYPES, daily_reports
from cotaflow.sources.tables import merge_table, write_table


def landed_lines(
    spark: SparkSession,
    folder: str,
    archives: str | None = "*.zip",
    files: str | None = "*.csv",
    problems: str | None = None,
) -> DataFrame:
    """Every line of every archive and text file in a folder, under the published names.

    A folder may hold only archives or only files; an archive without a matching file is an error.
    ``problems`` names a column that holds the whole line where a field could not be read.
    """
    parts = []
    if archives and any_match(spark, folder, archives):
        parts.append(read_archives(spark, folder, DAILY_TYPES, archives, files or "*.csv", problems=problems))
    if files and any_match(spark, folder, files):
        parts.append(read_delimited(spark, folder, DAILY_TYPES, files, problems=problems))
    if not parts:
        raise FileNotFoundError(f"neither {archives} nor {files} in {folder}")
    raw = union_by_name(parts)
    absent = [n for n in DAILY_TYPES if n not in raw.columns]
    return raw.withColumns({n: F.lit(None).cast(DAILY_TYPES[n]) for n in absent}) if absent else raw


def landed_reports(
    spark: SparkSession, folder: str, archives: str | None = "*.zip", files: str | None = "*.csv"
) -> DataFrame:
    """Daily reports of every archive and text file in a folder, in library names."""
    return daily_reports(landed_lines(spark, folder, archives, files))


def problem_lines(
    spark: SparkSession, folder: str, archives: str | None = "*.zip", files: str | None = "*.csv"
) -> DataFrame:
    """``line`` of each landed line with a field that does not fit its type, or with too many or too few fields.

    ``landed_reports`` keeps such lines, with NULL for what can't be read.
    """
    raw = landed_lines(spark, folder, archives, files, "__problem")
    return raw.where("__problem IS NOT NULL").select(F.col("__problem").alias("line"))


def consolidate(
    reports: DataFrame, path: str, mode: str = "create", clustered: bool = True, absent: str = "keep", undated: str = "refuse"
) -> None:
    """Write daily reports as a table partitioned by year and month, so that ranges of days skip files.

    ``restate`` rewrites the months that occur in ``reports`` and leaves all others; it refuses a month of
    which the table has fund-days that ``reports`` lack, and undated rows.  ``merge`` takes in any part of a
    month: reports replace those of the same fund and day, others of the month are kept or with ``absent="end"``
    end, and undated reports are refused or with ``undated="add"`` added (``tables.merge_table``).  ``clustered`` keeps
    a fund's days of a month together, which pays off when the table is read more often than written.
    """
    dated = reports.withColumns({YEAR_PARTITION: F.year("dt"), MONTH_PARTITION: F.month("dt")})
    cluster_by = ["fund", "dt"] if clustered else None
    if mode == "merge":
        merge_table(dated, path, [YEAR_PARTITION, MONTH_PARTITION], ["fund", "dt"], cluster_by, absent, undated)
    else:
        write_table(dated, path, mode, [YEAR_PARTITION, MONTH_PARTITION], cluster_by, ["fund", "dt"])
