from __future__ import annotations

import os

import pytest

from gatelens.session import local_session

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("GATELENS_TEST_DIR", str(tmp_path_factory.mktemp("shared")))
    session = local_session(cpus=8, memory="6g", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
