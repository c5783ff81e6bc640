import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemill.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session(
        "tests",
        cpus=8,
        **{
            "spark.checkpoint.dir": f"file://{shared}/checkpoints",
            "spark.sql.warehouse.dir": f"{shared}/warehouse",
            "spark.driver.memory": "6g",
            "spark.sql.shuffle.partitions": "4",
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
