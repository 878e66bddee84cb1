import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from revlens.session import local_session, ship_package  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "revlens-tests", 4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared"))
    )
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
