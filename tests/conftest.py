import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"


from pyspark.sql import SparkSession  # noqa: E402

#: Made before the tests are collected, as some modules name windows when they are imported.
_SPARK = (
    SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
    .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
)
_SPARK.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    yield _SPARK
    _SPARK.stop()
