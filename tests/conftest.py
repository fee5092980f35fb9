from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from quernstone.session import local_session

    s = local_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def small():
    if not SMALL.exists():
        pytest.skip("no test tables here")
    return str(SMALL)


def rows(df, *cols):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
