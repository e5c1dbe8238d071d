import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from placequery.functions.shipping import ship_package  # noqa: E402
from placequery.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "8g", 8)
    ship_package(session)
    yield session
    session.stop()
