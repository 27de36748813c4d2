import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from graphloom.runtime import session

    built = session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    built.sparkContext.setLogLevel("ERROR")
    yield built
