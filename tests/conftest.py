import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from loomdex.runtime import local_session, on_workers

    return on_workers(local_session(4, "4g"))


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
