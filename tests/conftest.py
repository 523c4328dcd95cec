from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import checkall  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return checkall.session()


@pytest.fixture(scope="session")
def duck():
    return checkall.connect(SF_DIR)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
