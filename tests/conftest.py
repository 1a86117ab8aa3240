import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cotaflow.session import local_session
from cotaflow.sources.scratch import release


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", "4g")
    yield session
    release(session)
    session.stop()


@pytest.fixture
def no_broadcast(spark):
    """Every lookup counts as too large to broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


@pytest.fixture
def frame(spark):
    """Small table of a known size."""

    def make(ddl, *data):
        schema = to_arrow_schema(StructType.fromDDL(ddl))
        columns = [pa.array([row[i] for row in data], kind) for i, kind in enumerate(schema.types)]
        return spark.createDataFrame(pa.table(columns, schema=schema))

    return make


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
