"""Numbers as text, patterns that only other engines know, and line numbers when splits move."""

import pytest
from pyspark.sql import functions as F

import logweir as lw
from logweir.functions.numbers import plain_number


def test_numbers_are_written_plainly(spark):
    cases = {
        120.0: "120", 1.2e7: "12000000", 1e-4: "0.0001", 0.5: "0.5", 0.0: "0", -3.25e8: "-325000000", 123456789.125: "123456789.125",
        1e20: "100000000000000000000", 1.5e21: "1.5e+21", 1e-7: "1e-7", 2.5e-6: "0.0000025", 1.25e-5: "0.0000125", 1.2345678901e-5: "0.000012345678901",
    }
    rows = spark.createDataFrame([(x,) for x in cases] + [(None,)], "x double").select("x", plain_number(F.col("x")).alias("text"))
    assert {r.x: r.text for r in rows.collect()} == cases | {None: None}


@pytest.mark.parametrize(
    "pattern, kept",
    [("^/a{b$", ["/a{b"]), ("/[^]*b", ["/a{b", "/x/b"]), ("^/a{1}$", ["/a"]), ("/c{,2}", ["/c{,2}"]), ("[]", []), ("a$|[{]", ["/a", "/a{b", "/c{,2}"])],
)
def test_user_patterns_mean_what_they_mean_elsewhere(spark, pattern, kept):
    rows = spark.createDataFrame([("/a{b", "r"), ("/a", "r"), ("/x/b", "r"), ("/c{,2}", "r")], "path string, raw string")
    assert sorted(r.path for r in lw.filter_logs(rows, path=pattern).collect()) == sorted(kept)


def test_a_reference_before_its_group_is_told(parse):
    with pytest.raises(ValueError, match="before it"):
        parse("custom", "x", pattern=r"\k<level>(?<level>a)")


def test_moved_splits_are_an_error(spark, tmp_path):
    (tmp_path / "x.log").write_text("".join(f"line {i} {'y' * (i % 40)}\n" for i in range(4000)))
    size = "spark.sql.files.maxPartitionBytes"
    before, parts = spark.conf.get(size), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set(size, "20000")
        numbered = lw.read_lines(spark, str(tmp_path))
        got = {r.line_number: r.value.split()[1] for r in numbered.collect()}
        assert got == {i + 1: str(i) for i in range(4000)}
        for other in ("7000", "33000"):
            spark.conf.set(size, "20000")
            numbered = lw.read_lines(spark, str(tmp_path))
            spark.conf.set(size, other)
            with pytest.raises(Exception, match="split anew"):
                numbered.collect()
    finally:
        spark.conf.set(size, before)
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_summary_of_nothing(spark):
    none = spark.createDataFrame([(0, 0, None)], "total long, matched long, percentage double")
    assert lw.filter_summary_json(none).first().value == '{"total":0,"matched":0,"percentage":"NaN"}'
