import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("workspace")))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def items_of(spark, golds):
    rows = [(i, g if isinstance(g, list) else [g]) for i, g in enumerate(golds)]
    return spark.createDataFrame(rows, "item_id long, gold array<string>")


def predictions_of(spark, **systems):
    rows = [
        (name, i, p if isinstance(p, list) else [p])
        for name, preds in systems.items() for i, p in enumerate(preds)
    ]
    return spark.createDataFrame(rows, "system string, item_id long, labels array<string>")
