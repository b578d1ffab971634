import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from matchlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Tiny inputs: compiling the generated code would take most of the time.
    conf = {"spark.driver.memory": "8g", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    session = build_session("tests", "local[8]", partitions=4, **conf)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression."""

    def run(expression):
        return spark.range(1).select(expression.alias("v")).first()["v"]

    return run
