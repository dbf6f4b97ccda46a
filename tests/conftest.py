import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ":".join([ROOT, os.environ.get("PYTHONPATH", "")])

from vitrail import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session.local(2, 4)


@pytest.fixture(scope="session")
def sf():
    return SMALL
