import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from cuelake.session import LOCAL_DEFAULTS, ensure_checkpoint_dir

    b = SparkSession.builder.master("local[*]").appName("cuelake-tests").config("spark.sql.shuffle.partitions", "8")
    for k, v in LOCAL_DEFAULTS.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


def one_col(spark, values, name="t"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")
