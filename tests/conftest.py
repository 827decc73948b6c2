import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    """A plain session as any caller has it: ANSI on, no setting of this package."""
    from oracle_check import plain_session
    s = plain_session("local[4]", 4)
    from kandle.session import tune
    tune(s)
    yield s


SF = "/root/testdata/sf0.001"
