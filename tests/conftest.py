from __future__ import annotations

import pytest

from tidewatch.session import build_session, tune


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tidewatch-tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()
