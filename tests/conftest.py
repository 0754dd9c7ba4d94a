import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from txrisk.session import local_session

    s = local_session("*", 8, app="txrisk-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf001():
    return SF001


@pytest.fixture(scope="session")
def sf01():
    return SF01


def rows(df, cols=None, ndigits=9):
    """Sorted plain tuples of a (small) result, floats rounded."""
    out = []
    for r in df.collect():
        d = r.asDict()
        keys = cols or sorted(d)
        out.append(tuple(round(d[k], ndigits) if isinstance(d[k], float) else d[k] for k in keys))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))
