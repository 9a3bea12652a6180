import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("veingraph-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ring(spark):
    """Eight vertices, twelve edges, no loop and no reciprocal edge."""
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (3, 5), (5, 4), (5, 6), (6, 7), (7, 8), (6, 8), (1, 6), (8, 5)]
    rows = [(f"node:{a}", "urn:connectedTo", f"node:{b}") for a, b in pairs]
    return spark.createDataFrame(rows, "s string, p string, o string").cache()
