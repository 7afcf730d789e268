from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from diamondframe.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="diamondframe-tests-")
    session = local_session(8, spark__checkpoint__dir=folder)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
