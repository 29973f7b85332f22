import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from deckscope.session import get_spark

    s = get_spark("local[4]", app="deckscope-tests", shuffle_partitions=8,
                  extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]
