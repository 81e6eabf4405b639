import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wirelens.workspace import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session(
        "wirelens-tests", "local[4]", spark__sql__shuffle__partitions=4,
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
