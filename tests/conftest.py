import pytest

from sketchloom.session import session, ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session(cpus="4", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield ship(spark)
    spark.stop()
