import pytest
from pyspark.sql import Column

from joblattice.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "joblattice-tests")
    yield session
    session.stop()


@pytest.fixture
def pairs(spark):
    """Evaluates a column expression over rows of a one-row-per-case table."""

    def run(rows, schema, build, out="out"):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_i int, " + schema)
        done = df.withColumn(out, build) if isinstance(build, Column) else build(df)
        return [r[out] for r in done.orderBy("_i").collect()]

    return run
