import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cartlens.session import local_session
    s = local_session("4", shuffle_partitions=8, app="cartlens-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect selected columns as a sorted list of tuples."""
    return sorted(tuple(r) for r in df.select(*cols).collect())
