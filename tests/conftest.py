import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF = "/root/testdata/sf0.001"
T0 = 1704067200000


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ordertide import session

    s = (
        session.builder("tests").master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def golden(spark):
    from ordertide.schemas import ORDER_EVENT

    rows = [
        ("e1", "o1", "c1", "R1", "I1", 2, 1299, 1000), ("e2", "o1", "c1", "R1", "I2", 1, 1499, 2000), ("e3", "o2", "c2", "R1", "I1", 1, 1299, 30000),
        ("e3", "o2", "c2", "R1", "I1", 1, 1299, 30000), ("e4", "o3", "c1", "R2", "I1", 4, 1299, 59999), ("e5", "o4", "c3", "R2", "I3", 3, 899, 60000),
        ("e6", "o5", "c1", "R1", "I1", 1, 1299, 61000),
    ]
    return spark.createDataFrame([(e, o, c, r, i, "C", "n" + i, q, p, T0 + t) for e, o, c, r, i, q, p, t in rows], ORDER_EVENT)
