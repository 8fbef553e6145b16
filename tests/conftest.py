import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from checks.compare import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(memory="6g")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def rows():
    """Rows of a small table as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
