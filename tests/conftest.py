import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wordloom.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4)
    yield s


@pytest.fixture
def tmp_out(spark):
    from wordloom.session import scratch_path
    return lambda name: scratch_path(spark, name)
