import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from log_samples import SAMPLE, write_lines  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from tidelog import configure
    s = (SparkSession.builder.master("local[4]").appName("tidelog-tests")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidelog-test-ckpt-"))
    configure(s)
    yield s


@pytest.fixture
def workdir():
    return tempfile.mkdtemp(prefix="tidelog-test-")


@pytest.fixture
def sample_store(spark, workdir):
    from tidelog.catalog import LogStore
    from tidelog.operators import load as L
    src = os.path.join(workdir, "bucket")
    write_lines(os.path.join(src, "logs", "a.ndjson"), SAMPLE)
    store = LogStore(spark, os.path.join(workdir, "store"))
    spec = store.create_source("Sample App", "path", {"root": src}, prefix="logs/")
    summaries = L.load_files(store, spec, ["logs/a.ndjson"])
    return store, spec, src, summaries
