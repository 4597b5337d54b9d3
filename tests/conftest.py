import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session, share_code

    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    share_code(session)
    yield session
    session.stop()
