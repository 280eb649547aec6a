"""A small local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessella.session import session

    folder = tmp_path_factory.mktemp("spark")
    conf = {
        "spark.master": "local[8]", "spark.driver.memory": "6g", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
        "spark.checkpoint.dir": f"file://{folder}/shared", "spark.sql.warehouse.dir": f"{folder}/warehouse",
    }
    made = session("tests", **conf)
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
