from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from termloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = local_session(
        os.environ.get("TEST_CPUS", "8"),
        shuffle_partitions=4,
        **{
            "spark.sql.warehouse.dir": str(base / "warehouse"),
            "spark.checkpoint.dir": str(base / "shared"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Frame of text columns (or a given schema) from rows of Python values."""

    def make(columns, *rows, types=None):
        names = columns.split()
        kinds = types.split() if types else ["string"] * len(names)
        schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
        return spark.createDataFrame(list(rows), schema)

    return make
