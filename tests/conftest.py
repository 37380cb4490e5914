import pytest

from readloom.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = ship(local_session("tests", cores=4, partitions=4, memory="4g"))
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def write(tmp_path):
    def put(name: str, data) -> str:
        path = tmp_path / name
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(path)

    return put
