import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from vecquarry.session import local_session, prepare

    s = local_session(8, 4, "6g")
    s.sparkContext.setLogLevel("ERROR")
    yield prepare(s)
    s.stop()


@pytest.fixture(scope="session")
def sf():
    d = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    return d
