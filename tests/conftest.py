import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from reposift.session import build_session

    session = build_session(
        "reposift-tests", "local[4]", spark__sql__shuffle__partitions=4, spark__driver__memory="6g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def work(spark):
    from reposift.session import work_path

    return lambda name="t": work_path(spark, name)
