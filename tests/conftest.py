import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("SINISTRA_TEST_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from sinistra.session import local_session

    s = local_session(8, shuffle_partitions=8, app="sinistra-tests")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF
