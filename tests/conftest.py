import os
import tempfile

import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    found = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    found.sparkContext.setLogLevel("ERROR")
    return found


@pytest.fixture(scope="session")
def small():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path
