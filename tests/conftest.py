import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from zonelens.session import get_session

    session = get_session(master="local[*]", shuffle_partitions=8, app="zonelens-tests")
    yield session
    session.stop()


@pytest.fixture
def tmp_dir():
    import tempfile

    return tempfile.mkdtemp(prefix="zonelens-test-", dir="/tmp")
