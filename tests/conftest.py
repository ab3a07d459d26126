import pytest

from outings.session import builder


@pytest.fixture(scope="session")
def spark():
    session = (
        builder("tests").master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def values(spark):
    """Evaluate a column expression over a list of texts."""
    from pyspark.sql import functions as F

    def run(texts, expression):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        rows = df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()
        return [r.v for r in rows]

    return run
