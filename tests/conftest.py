import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from larkspur import session

    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    found = session("local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="3g", spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}")
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
