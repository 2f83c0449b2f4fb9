import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reviewmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = build_session(
        "local[4]", 4, spark__ui__enabled="false", spark__driver__memory="6g", spark__checkpoint__dir=shared
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
