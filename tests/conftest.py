import os
import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def new_folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def write_file(path, text, age=0):
    """``age`` in seconds before a fixed moment, as modification time."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as file:
        file.write(text)
    os.utime(path, (1_700_000_000 - age,) * 2)
    return path


@pytest.fixture
def folder():
    """A new folder per test; nothing is deleted afterwards."""
    return new_folder()


@pytest.fixture
def write():
    return write_file
