import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from keepsake.session import build_session

    session = build_session("tests", 8)
    yield session
    session.stop()
