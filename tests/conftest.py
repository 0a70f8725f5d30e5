import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from topicloom.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session("tests", 4, spark__checkpoint__dir=str(shared),
                            spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
                            spark__sql__shuffle__partitions="4")
    yield session
    session.stop()
