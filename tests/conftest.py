import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from data_dirs import SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from panelscore.session import build_session

    s = build_session(master="local[8]", shuffle_partitions=8)
    s.sparkContext.addPyFile(os.path.join(ROOT, "tests", "echo_client.py"))  # workers unpickle the offline client
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    sys.path.insert(0, os.path.join(ROOT, "tools"))
    from oracle_check import duck

    return duck(SF_SMALL)
