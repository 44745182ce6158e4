import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from emberlog.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("emberlog-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from dicts; missing fields are NULL."""
    from pyspark.sql import functions as F

    from emberlog.functions.times import event_time_ms
    from emberlog.model import EVENT_SCHEMA

    def make(*rows):
        data = [tuple(r.get(n) for n in EVENT_SCHEMA.names) for r in rows]
        df = spark.createDataFrame(data, EVENT_SCHEMA)
        return df.withColumn("ts_ms", event_time_ms(F.col("ts")))

    return make
