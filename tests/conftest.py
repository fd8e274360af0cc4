import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from grantflow.session import get_spark
    s = get_spark(cpus=4, shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture
def tmpdir_(tmp_path):
    return str(tmp_path)
