import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pizarra.session import build_session, clear_stage

    s = build_session(master="local[*]", shuffle_partitions=8, app="pizarra-tests")
    yield s
    clear_stage(s)
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
