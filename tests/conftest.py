import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "scripts")]

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from slate.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=8, extra_conf={"spark.driver.memory": "4g"})
    yield s
    s.stop()


def rows(df, *cols):
    """Collect as a sorted list of tuples (optionally only some columns)."""
    out = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in out.collect()),
                  key=lambda t: tuple((True, 0) if x is None else (False, x) for x in t))
