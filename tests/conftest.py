import pytest

from tracewood.session import local_session, ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, memory="4g", shuffles=4, **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    ship(session)
    yield session
    session.stop()
