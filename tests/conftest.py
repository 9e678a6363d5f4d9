import pytest
from pyspark.sql import functions as F

from feedloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Evaluate a column expression over a list of strings."""

    def run(function, values, kind="string"):
        rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
        return [r[1] for r in rows.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]

    return run
