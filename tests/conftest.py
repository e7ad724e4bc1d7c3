import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from logweave.session import get_spark

    s = get_spark(
        "local[4]",
        app="logweave-tests",
        shuffle_partitions=4,
        extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="logweave-test-ckpt-")},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def lines_df(spark, lines, source="t"):
    rows = [(source, i + 1, l) for i, l in enumerate(lines)]
    return spark.createDataFrame(rows, "source string, line_no bigint, raw_line string")
