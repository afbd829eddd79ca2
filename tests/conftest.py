import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sessionloom.session import local_session

    s = local_session(cores=8, partitions=4, name="sessionloom-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
