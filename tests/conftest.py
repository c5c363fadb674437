"""A session for all tests."""

import pytest

from clausewright.session import get_spark, ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_spark("tests", "local[4]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("w"))})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
