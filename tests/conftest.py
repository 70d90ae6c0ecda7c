import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lavra.runtime import session, ship

    out = session("tests", "local[4]", 4)
    out.sparkContext.setLogLevel("OFF")
    ship(out)
    yield out
    out.stop()
