import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from swathe.session import local_session  # noqa: E402
from swathe.sources.fixtures import Tables  # noqa: E402

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, memory="6g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small(spark):
    return Tables(spark, SMALL)


@pytest.fixture(scope="session")
def mid(spark):
    return Tables(spark, MID)
