from __future__ import annotations

import pytest

from panelkit.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF_SMALL, SF_MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def small():
    return SF_SMALL


@pytest.fixture(scope="session")
def medium():
    return SF_MEDIUM
