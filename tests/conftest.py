import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from shoalgraph.session import session

    os.environ.setdefault("BENCH_CPUS", "4")
    return session("tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
