import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from voxtally.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("voxtally-tests", cores=8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def values(spark):
    """Evaluate an expression of one column ``x`` for each given value."""

    def run(items, expression, kind="string"):
        frame = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}")
        return [r[0] for r in frame.orderBy("i").select(expression).collect()]

    return run
