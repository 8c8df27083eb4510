import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from chronoweave.session import prepare

    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.codegen.wholeStage", "false").config("spark.sql.codegen.factoryMode", "NO_CODEGEN")  # tiny inputs: compiling costs most
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield prepare(session)
    session.stop()


@pytest.fixture
def rows(spark):
    """Frame from dicts under a DDL contract; absent fields are null."""
    from chronoweave import schemas

    def make(ddl, *records):
        names = schemas.columns(ddl)
        unknown = {key for record in records for key in record} - set(names)
        assert not unknown, unknown
        return spark.createDataFrame([tuple(record.get(name) for name in names) for record in records], schemas.struct(ddl))

    return make
