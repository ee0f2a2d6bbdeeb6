import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
os.environ.setdefault("PAGETRAIL_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from pagetrail.plans.session import local_session

    session = local_session(4, partitions=2)
    yield session
    session.stop()
