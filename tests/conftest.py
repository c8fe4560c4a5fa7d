import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shopguard.session import get_session

    s = get_session("local[4]", 4, app="shopguard-tests")
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from shopguard.plans.verify import duck

    return duck(SMALL)
