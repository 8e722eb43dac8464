"""One small local session for all tests."""

import os
import tempfile

import pytest
from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="spark-tests-")
    conf = SparkConf().setMaster("local[4]").setAppName("tests")
    for key, value in {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "3g", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": shared,
    }.items():
        conf.set(key, value)
    session = SparkSession(SparkContext.getOrCreate(conf))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
