import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def ctx_of(spark):
    """A context over hand-made frames: ctx_of(as_of, {"billing.usage": df})."""
    from spendscope import Catalog, Ctx

    def make(as_of=dt.date(2024, 3, 31), tables=None, **kw):
        locations = {name: (lambda s, df=df: df) for name, df in (tables or {}).items()}
        return Ctx(spark, Catalog(spark, locations), as_of=as_of, **kw)

    return make
