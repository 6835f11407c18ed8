import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wattline.session import get_spark

    s = get_spark("local[4]", app="wattline-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="wattline-test-")


@pytest.fixture(autouse=True)
def _free_helper_tables():
    """Helper tables that a test's queries cached are freed after it."""
    yield
    from wattline.session import release_cached

    release_cached()
