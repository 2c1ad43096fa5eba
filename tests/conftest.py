import pytest
from pyspark.sql import SparkSession

from tidescore.sources import drop_schema, scratch_schema


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", str(folder / "shared"))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def schema(spark):
    name = scratch_schema(spark, "test")
    yield name
    drop_schema(spark, name)


@pytest.fixture
def rows():
    """Rows of a frame as sorted plain tuples, nulls first."""
    def collect(df):
        return sorted((tuple(row) for row in df.collect()),
                      key=lambda row: [(value is not None, value) for value in row])
    return collect
