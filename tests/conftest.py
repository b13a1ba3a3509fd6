import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from corvane.session import session

    s = session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    return s
