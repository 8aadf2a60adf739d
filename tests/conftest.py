import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    b = SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="loomfit-tests-"))
    s = b.config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    from loomfit.session import ship

    ship(s)
    yield s
    s.stop()


@pytest.fixture
def rows():
    """A data frame's rows as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=str)
