import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    session = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", folder).config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, spans string, kept string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, and columns that results also have."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    long = " ".join(words[(i * i + i // 7) % 12] + str(i % 97) for i in range(40_000))
    plain = "The old house stood near the river, and every spring the water rose to its door. People came to look at it from the bridge, then went home."
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n", None, None, 3), (4, long, "en", "a", len(long)),
        (5, plain, "en", "b", len(plain)), (5, plain, "en", "b", len(plain)), (6, plain, None, None, None), (None, plain + " Yes.", "en", "b", 9),
        (7, "été à la plage 日本語 \U0001f600 ▁x\r\n\ty\x00z " * 5, "fr", "c", 7), (8, "a@b.co +1 (408) 555-7800 10.0.0.1 4111 1111 1111 1111 token=abcdef123", "en", "c", 1), (9, "12345", "de", "c", 5),
    ]
    return spark.createDataFrame([(*r, 0.5, "x", "y", "z") for r in rows], COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (8, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
