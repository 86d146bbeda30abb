import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from creditmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("creditmill-tests", "8", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
