import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def corpus(spark):
    """Two works with editions and segments by hand: (id, work, year, language, [(seq, chapter, content)])."""
    from pyspark.sql import functions as F

    from lectern import schema
    from lectern.functions import text as X

    def make(works, editions, segments):
        w = spark.createDataFrame([(i, t, None, None, y, g, [], None, None) for i, t, y, g in works], schema.WORKS)
        e = spark.createDataFrame([(i, w_, lang, "epub", None, False, None, at) for i, w_, lang, at in editions], schema.EDITIONS)
        s = spark.createDataFrame([(i, ed, seq, c, None, t, None) for i, ed, seq, c, t in segments], schema.SEGMENTS).withColumn("tok", X.token_text(F.col("content")))
        return s, e, w

    return make
