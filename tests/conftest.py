import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]").appName("tablelens-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.python.sql.dataFrameDebugging.enabled", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from tablelens.session import scratch_dir
    scratch_dir(s)
    yield s


F1_ROWS = [
    (1, 25, 50000, 80, "A"), (2, 35, 60000, 85, "B"), (3, 45, 70000, 90, "A"), (4, 22, 45000, 75, "B"),
    (5, 50, 90000, 95, "A"), (6, 28, 52000, 82, "B"), (7, 40, 65000, 88, "A"), (8, 32, 58000, 81, "B"),
    (9, 48, 80000, 92, "A"), (10, 26, 48000, 78, "B"), (11, 38, 62000, 86, "A"), (12, 42, 75000, 91, "B"),
    (13, 30, 55000, 84, "A"), (14, 55, 100000, 98, "B"), (15, 24, 49000, 79, "A"),
]


@pytest.fixture(scope="session")
def f1(spark):
    return spark.createDataFrame(F1_ROWS, "id long, age long, income long, score long, target string")
