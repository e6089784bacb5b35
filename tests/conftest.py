import pytest

from quillmark.session import session, ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    found = session(
        "local[4]",
        "tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))},
    )
    found.sparkContext.setLogLevel("ERROR")
    yield ship(found)
    found.stop()
