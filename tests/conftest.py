import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def tables(spark):
    from bidspan.registry.tables import Tables

    return Tables(spark, SF)


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over given constants."""

    def value(make, *args, schema=None):
        names = [f"c{i}" for i in range(len(args))]
        df = spark.createDataFrame([tuple(args)], schema or _schema(args, names))
        from pyspark.sql import functions as F

        return df.select(make(*[F.col(n) for n in names]).alias("v")).first()["v"]

    def _schema(args, names):
        kinds = {str: "string", int: "long", float: "double", bool: "boolean", bytes: "binary", type(None): "string", list: "array<string>"}
        return ", ".join(f"{n} {kinds[type(a)]}" for n, a in zip(names, args))

    return value
