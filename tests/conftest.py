import pytest

from placewright.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
