import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents():
    import pyarrow.dataset as ds

    return ds.dataset(f"{SF}/documents.parquet").to_table().to_pylist()


#: Nulls, empties, one very long text, ties, repeated rows.
ODD_TEXTS = [None, "", " \n\t ", "one", "a\x00b \x1c c\x85d", "Ünïcode ΑΣ wörter" * 3, "same line\nsame line\nsame line\n" * 12, "x" * 200_000, "word " * 40_000]


@pytest.fixture
def odd_documents(spark):
    rows = [(i, t, "src") for i, t in enumerate(ODD_TEXTS)] + [(3, "one", "src"), (3, "one", "src"), (None, "null id here", None), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, __bad string")
