import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from logweir import configure

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def parse(spark):
    """Parse a list of lines; returns one dict per line, in order."""
    from logweir import LINES, parse_lines

    def run(format, *values, **options):
        rows = [("f", i + 1, v) for i, v in enumerate(values)]
        options.setdefault("syslog_year", 2024)
        parsed = parse_lines(spark.createDataFrame(rows, LINES), format, **options)
        return [r.asDict() for r in parsed.orderBy("line_number").collect()]

    return run
