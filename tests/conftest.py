import pytest


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    entry.ship(session)
    return session
