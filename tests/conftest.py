import contextlib
import io
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusflow.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plan_text(df) -> str:
    """The formatted physical plan."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def tight(spark):
    """Limits so small that every group counts as hot and is worked on in pieces."""
    settings = {"spark.corpusflow.groupRows": "5", "spark.corpusflow.blockRows": "16"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield settings
    for key in settings:
        spark.conf.unset(key)
