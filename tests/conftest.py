from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from tidewell.session import local_session, ship

    session = local_session("tests", "4", spark__driver__memory="3g", spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
