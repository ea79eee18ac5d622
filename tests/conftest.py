import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from grainmill.session import clear_scratch, local_session

    session = local_session(8, "grainmill-tests")
    yield session
    clear_scratch(session)
    session.stop()

