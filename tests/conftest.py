import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from usagelens.session import local_session  # noqa: E402

SMALL_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app="usagelens-tests")
    yield s
    s.stop()


def ts(*parts) -> dt.datetime:
    return dt.datetime(*parts)


def rows(df, *cols):
    """Sorted list of tuples of the given columns (all columns when none given)."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=repr)
