import logging
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import create_session

    s = create_session("local[8]", {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    logging.getLogger("SQLQueryContextLogger").setLevel(logging.CRITICAL + 1)  # tests raise errors on purpose
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
