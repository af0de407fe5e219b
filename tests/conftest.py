import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[*]")
         .appName("rowsift-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def records(spark):
    rows = [
        (1, "Type 2 Diabetes", 54, 1.0),
        (2, "diabetes mellitus", 61, 0.5),
        (3, "Hyperglycemia", 47, None),
        (4, None, 30, 2.0),
        (5, "Éclampsie", 29, 1.5),
        (6, "Asthma (severe)", None, 1.0),
    ]
    return spark.createDataFrame(rows, "PatientID long, DiseaseName string, Age int, Dose double")


def ids(df, col="PatientID"):
    return sorted(r[0] for r in df.select(col).collect())


@pytest.fixture
def tmp_out(tmp_path):
    return str(tmp_path)
