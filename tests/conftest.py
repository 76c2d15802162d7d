from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarryline.session import build_session


# Started on import: column expressions in parametrised tests need a session.
SESSION = build_session(
    "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
)
SESSION.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over one row of named values."""
    from pyspark.sql import functions as F

    def value(expression, **values):
        row = spark.range(1)
        for name, v in values.items():
            row = row.withColumn(name, v if hasattr(v, "_jc") else F.lit(v))
        return row.select(expression.alias("v")).first().v

    return value
