import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from vetrina.session import build_session
    s = build_session("local[4]", app="vetrina-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from vetrina.plans.compare import duckdb_conn
    return duckdb_conn(SMALL)
