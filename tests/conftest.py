import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from verbatlas.session import get_spark

    shared = tmp_path_factory.mktemp("shared")
    session = get_spark("tests", cpus=4, **{"spark.checkpoint.dir": f"file://{shared}", "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
