import pytest

from ruleframe.session import get_or_create, ship


@pytest.fixture(scope="session")
def spark():
    session = ship(get_or_create(4, 4, "3g"))
    yield session
    session.stop()


@pytest.fixture
def rows():
    """The rows of a table as a sorted list of tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
