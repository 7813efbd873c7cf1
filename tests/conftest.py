import os

import pytest

from tools.check import connect
from wardlens.session import get_spark
from wardlens.sources.tables import Tables

SMALL = os.environ.get("WARDLENS_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": 4, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SMALL)


@pytest.fixture(scope="session")
def database():
    return connect(SMALL)
