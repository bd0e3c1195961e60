import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return session(cores=8, shuffle=4, shared=str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def rows():
    """Collected rows as sorted tuples."""
    return lambda df: sorted(tuple(r) for r in df.collect())
