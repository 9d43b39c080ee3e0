import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import session

    made = session(
        "tests",
        "local[4]",
        4,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="lodestone-wh-"), "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="lodestone-ck-")},
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


DATA = "/root/testdata"


@pytest.fixture(scope="session")
def sf():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path
