import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from termwright.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", "8", 4)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
