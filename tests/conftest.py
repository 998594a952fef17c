import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from florile.session import session

    s = session(memory="6g", shuffle=8)
    s.sparkContext.setLogLevel("ERROR")
    return s
