import os

import pytest
from pyspark.sql import functions as F

from logweir import parse_logs
from logweir.plans import follow_report
from logweir.streaming import follow_lines, live_counts, number_batches, tail_view, untimed_counts
from logweir.streaming.follow_source import LogFollowReader


@pytest.fixture
def follow(spark, tmp_path):
    """Run a followed stream until it has caught up; returns all rows written so far."""

    def run(initial="all", **options):
        lines = follow_lines(spark, str(tmp_path / "in" / "*.log"), initial, **options)
        query = (
            lines.writeStream.format("parquet")
            .option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((os.path.basename(r.file), r.value) for r in rows)

    (tmp_path / "in").mkdir()
    return run


def append(path, text, mode="a"):
    with open(path, mode) as out:
        out.write(text)


def test_follow_appends_partial_lines_and_truncation(follow, tmp_path):
    a, b = tmp_path / "in" / "a.log", tmp_path / "in" / "b.log"
    append(a, "one\n\ntwo\nthr")
    assert follow() == [("a.log", "one"), ("a.log", "two")]
    append(a, "ee\n")
    append(b, "first\n")
    assert follow() == [("a.log", "one"), ("a.log", "three"), ("a.log", "two"), ("b.log", "first")]
    append(a, "new\n", "w")
    assert ("a.log", "new") in follow()


@pytest.mark.parametrize("size", [1, 3, 7, 50, 1000])
def test_byte_ranges_read_every_line_once(tmp_path, size):
    path = tmp_path / "x.log"
    text = "".join(f"line {i} é{'x' * (i % 23)}\n" for i in range(60)) + "open end"
    path.write_text(text, encoding="utf-8")
    reader = LogFollowReader({"path": str(path), "initialLines": "all", "rangeBytes": str(size)})
    end = reader.latestOffset()
    values = [
        v
        for part in reader.partitions({}, end)
        for batch in reader.read(part)
        for v in batch.column("value").to_pylist()
    ]
    assert values == text.split("\n")[:-1]


@pytest.mark.parametrize("n", [0, 1, 3, 10, 500])
def test_initial_lines(tmp_path, n):
    lines = [f"l{i}" + "x" * 700 if i % 3 else "  " for i in range(400)]
    path = tmp_path / "x.log"
    path.write_text("\n".join(lines) + "\nunfinished")
    reader = LogFollowReader({"path": str(tmp_path), "initialLines": str(n)})
    start, end = reader.initialOffset(), reader.latestOffset()
    values = [
        v for part in reader.partitions(start, end) for batch in reader.read(part)
        for v in batch.column("value").to_pylist() if v.strip()
    ]
    full = [x for x in lines if x.strip()]
    assert values == (full[-n:] if n else [])


def test_missing_file_keeps_its_position(tmp_path):
    path = tmp_path / "x.log"
    path.write_text("a\nb\n")
    reader = LogFollowReader({"path": str(tmp_path / "*.log"), "initialLines": "all"})
    end = reader.latestOffset()
    reader.partitions({}, end)
    os.rename(path, tmp_path / "x.old")
    assert reader.latestOffset() == end


def test_numbers_go_on_across_batches_and_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = tmp_path / "in" / "a.log"
    seen = {}

    def keep(numbered, batch_id):
        seen.update({r.line_number: r.value for r in numbered.collect()})

    for part in (["a", "", "b", "c"], ["d"], ["e", "f"]):
        append(path, "\n".join(part) + "\n")
        lines = follow_lines(spark, str(tmp_path / "in"), "all", range_bytes=3)
        (
            lines.writeStream.foreachBatch(number_batches(str(tmp_path / "state"), keep))
            .option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    assert seen == {i + 1: v for i, v in enumerate("abcdef")}


def test_tail_view_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    append(tmp_path / "in" / "a.log", "[ERROR] bad thing\n[INFO] good thing\n[WARN] Bad luck\n")
    rows = follow_report(spark, str(tmp_path / "in"), initial_lines=2, levels=["error", "warn"], highlight="bad")
    (
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True)
        .start().awaitTermination()
    )
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.level, r.detail) for r in got] == [("WARN", "<<Bad>> luck")]
    batch = spark.createDataFrame([("f", 1, "[WARN] Bad luck")], "file string, line_number long, value string")
    assert tail_view(batch, "custom", highlight="bad").first().detail == "<<Bad>> luck"


def test_live_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    append(tmp_path / "in" / "a.log", "2024-01-01 00:10:00 [ERROR] x\n2024-01-01 00:50:00 [ERROR] y\n2024-01-01 05:00:00 [INFO] z\nplain\n")
    out = {}
    for name, build in (("timed", live_counts), ("untimed", untimed_counts)):
        entries = parse_logs(follow_lines(spark, str(tmp_path / "in"), "all"), "custom")

        def keep(batch, _, name=name):
            out[name] = sorted(tuple(r) for r in batch.select("level", "count").collect())

        (
            build(entries).writeStream.outputMode("complete").foreachBatch(keep)
            .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True)
            .start().awaitTermination()
        )
    assert out == {"timed": [("error", 2), ("info", 1)], "untimed": [("info", 1)]}
