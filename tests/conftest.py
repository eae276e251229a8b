import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("PYTHONPATH", ROOT)
if ROOT not in os.environ["PYTHONPATH"].split(":"):
    os.environ["PYTHONPATH"] = ROOT + ":" + os.environ["PYTHONPATH"]


@pytest.fixture(scope="session")
def spark():
    from sondage.session import local_session

    session = local_session("tests", cores=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
