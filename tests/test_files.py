import random

import pytest
from pyspark.sql import functions as F

from logweir import detect_format, head_lines, parse_lines, read_heads, read_lines, tail_lines, with_format
from logweir.operators import attach as attach_module
from logweir.operators.numbering import range_of
from logweir.plans import filter_report, filter_report_summary, parse_report, stats_report

APACHE = '1.1.1.1 - u [10/Oct/2024:13:55:36 +0000] "GET /{} HTTP/1.1" 200 5'
NGINX = '1.1.1.1 - - [10/Oct/2024:13:55:36 +0000] "GET /{} HTTP/1.1" 500 5 "-" "ua"'


@pytest.fixture
def logs(tmp_path):
    def write(**files):
        for name, lines in files.items():
            (tmp_path / f"{name}.log").write_bytes("\n".join(lines).encode())
        return str(tmp_path)

    return write


def numbered(df):
    return sorted((r.file.rsplit("/", 1)[1], r.line_number, r.value) for r in df.collect())


def expected(**files):
    return sorted(
        (f"{name}.log", i + 1, line)
        for name, lines in files.items()
        for i, line in enumerate([x for x in lines if x.strip()])
    )


@pytest.mark.parametrize("limit", [None, 0])
def test_numbering_is_independent_of_splits(spark, logs, monkeypatch, limit):
    """Many small splits, several files, and both ways to bring offsets to the lines."""
    if limit is not None:
        monkeypatch.setattr(attach_module, "BROADCAST_BYTES", limit)
    rng = random.Random(5)
    files = {
        name: [rng.choice(["", " \t", "line"]) and f"{name}-{i} " + "x" * rng.randint(0, 60) if rng.random() < 0.8 else "" for i in range(n)]
        for name, n in [("big", 6000), ("small", 7), ("mid", 900)]
    }
    path = logs(**files)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        lines = read_lines(spark, path)
        assert limit == 0 or lines.rdd.getNumPartitions() > 4
        assert numbered(lines) == expected(**files)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_split_at_line_feed_only(spark, logs):
    lines = read_lines(spark, logs(a=["one\rstill one\r", "", "two"]))
    assert [v for _, _, v in numbered(lines)] == ["one\rstill one\r", "two"]


def test_head_and_tail(spark, logs):
    path = logs(a=["1", "", "2", "3", " ", "4", "5"], b=["x"])
    lines = read_lines(spark, path, with_totals=True)
    assert numbered(tail_lines(lines, 2)) == [("a.log", 4, "4"), ("a.log", 5, "5"), ("b.log", 1, "x")]
    assert numbered(head_lines(lines, 1)) == [("a.log", 1, "1"), ("b.log", 1, "x")]
    assert tail_lines(lines, 0).count() == 0
    assert numbered(read_heads(spark, path, 2)) == [("a.log", 1, "1"), ("a.log", 2, "2"), ("b.log", 1, "x")]


def test_heads_of_long_files(spark, logs):
    path = logs(a=[" "] * 200_000 + ["x" * 200_000, "y", "z"])
    assert [(n, len(v)) for _, n, v in numbered(read_heads(spark, path, 2))] == [(1, 200_000), (2, 1)]


def test_detection(spark, logs):
    j = '{"a":1}'
    files = dict(
        combined=[NGINX.format(i) for i in range(5)],
        common=[APACHE.format(i) for i in range(5)],
        json3=[j, j, j, NGINX, NGINX],
        json2=[j, j, NGINX, NGINX, "other"],
        arrays=["[1]"] * 5,
        text=["a", "b"],
        late=["a"] * 5 + [j] * 20,
        blank_first=["", "", j, "", j],
    )
    path = logs(**files)
    want = dict(
        combined="nginx", common="apache", json3="json", json2="nginx", arrays="json",
        text="custom", late="custom", blank_first="json",
    )
    for lines in (read_heads(spark, path, 5), read_lines(spark, path)):
        got = {r.file.rsplit("/", 1)[1][:-4]: r.format for r in detect_format(lines).collect()}
        assert got == want


@pytest.mark.parametrize("limit", [None, 0])
def test_formats_reach_lines(spark, logs, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(attach_module, "BROADCAST_BYTES", limit)
    path = logs(a=[APACHE.format(i) for i in range(300)], n=[NGINX.format(i) for i in range(20)])
    lines = read_lines(spark, path)
    parsed = parse_lines(with_format(lines, detect_format(lines)))
    got = {(r.format, r.source): r["count"] for r in parsed.groupBy("format", "source").count().collect()}
    assert got == {("apache", "apache"): 300, ("nginx", "nginx"): 20}


def test_reports(spark, logs):
    path = logs(a=[APACHE.format(i) for i in range(60)] + ["junk"], n=[NGINX.format(1), "", "junk"])
    assert parse_report(spark, path).count() == 51
    tail = parse_report(spark, path, lines=2, from_tail=True).collect()
    assert sorted((r.source, r.line_number) for r in tail) == [("apache", 60), ("nginx", 1)]
    assert filter_report(spark, path, statuses=[500]).count() == 1
    assert filter_report_summary(spark, path, levels=["info"]).first() == (61, 60, 98.4)
    stats = stats_report(spark, path, top_n=2).first()
    assert (stats.total_lines, stats.parsed_lines, stats.failed_lines) == (63, 61, 2)
    assert [tuple(r) for r in stats.top_paths] == [("/1", 2), ("/0", 1)]
    assert stats.avg_response_time is None and stats.p95_response_time is None


def test_range_of(spark):
    cuts = [3, 5, 8, 9, 20, 21, 22]
    rows = spark.range(30).select("id", range_of(F.col("id"), cuts).alias("r")).collect()
    assert all(r.r == sum(c <= r.id for c in cuts) for r in rows)


def test_number_by_order_with_hot_file(spark):
    from logweir import lines_from_table

    rows = [(i, "hot" if i % 10 else "cold", f"v{i}\n\nw{i}") for i in range(2000)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "id long, f string, text string").repartition(7)
    lines = lines_from_table(table, "text", order_col="id", file_col="f")
    want = []
    for name in ("hot", "cold"):
        texts = [t for i, f, text in sorted(rows) if f == name for t in text.split("\n") if t]
        want += [(name, n + 1, t) for n, t in enumerate(texts)]
    assert sorted((r.file, r.line_number, r.value) for r in lines.collect()) == sorted(want)
