import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from planloom.session import local_session

    held = local_session("tests", cores=4, shared=f"file://{tmp_path_factory.mktemp('shared')}")
    yield held
    held.stop()
