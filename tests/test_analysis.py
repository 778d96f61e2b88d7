import csv
import io
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import logweir as lw
from logweir.functions import csv_field, highlight, truncate
from logweir.operators.export import has_http
from logweir.session import cut_lineage

START = datetime(2024, 1, 1)


@pytest.fixture
def entries(spark):
    def make(*rows):
        full = [
            {"file": "f", "format": "nginx", "line_number": i + 1, "level": "info", "message": "m",
             "source": "nginx", "raw": "Raw Line"} | row
            for i, row in enumerate(rows)
        ]
        names = lw.ENTRY_COLUMNS
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], lw.ENTRIES)

    return make


def kept(df):
    return sorted(r.line_number for r in df.collect())


def test_filters(entries):
    e = entries(
        dict(level="ERROR", status=500, ip="1.1.1.1", method="get", path="/API/x", timestamp=START),
        dict(level="info", status=200, ip="2.2.2.2", method="POST", path="/y[abc", timestamp=START + timedelta(hours=1)),
        dict(level="warn", raw="needle HERE"),
    )
    f = lambda **c: kept(lw.filter_logs(e, **c))
    assert f() == [1, 2, 3]
    assert f(levels=["error"]) == [1] and f(levels=["ERROR"]) == []
    assert f(statuses=["500", 404]) == [1]
    assert f(ips=["2.2.2.2"]) == [2] and f(ips=["2.2.2"]) == []
    assert f(methods=["Get"]) == [1]
    assert f(path="^/api/") == [1] and f(path="[abc") == [2] and f(path=r"x$") == [1]
    assert f(since="2024-01-01T01:00:00") == [2, 3] and f(until=START) == [1, 3]
    assert f(until=START, drop_untimed=True) == [1]
    assert f(contains="NEEDLE here") == [3] and f(not_contains="needle") == [1, 2]
    assert f(statuses=[500, 200], methods=["post"]) == [2]
    with pytest.raises(ValueError):
        f(since="not a time")
    assert lw.filter_summary(e, statuses=[500]).first() == (3, 1, 33.3)
    assert lw.filter_summary(e.limit(0), statuses=[500]).first() == (0, 0, None)


def brute_stats(rows):
    """The statistics by plain loops, to compare with."""
    times = sorted(r["response_time"] for r in rows if r.get("response_time") is not None)

    def rank(p):
        return times[max(0, -(-p * len(times) // 100) - 1)] if times else None

    def count(key):
        out = {}
        for r in rows:
            k = key(r)
            if k:
                out[k] = out.get(k, 0) + 1
        return out

    return {
        "levels": count(lambda r: r["level"].lower()),
        "statuses": count(lambda r: r.get("status") and f"{r['status'] // 100}xx"),
        "paths": sorted(count(lambda r: r.get("path")).items(), key=lambda kv: -kv[1])[:4],
        "hours": count(
            lambda r: r.get("timestamp") and (r["level"] == "error" or (r.get("status") or 0) >= 500)
            and r["timestamp"].strftime("%Y-%m-%dT%H")
        ),
        "p95": rank(95), "p99": rank(99), "bytes": sum(r.get("size") or 0 for r in rows),
    }


@pytest.mark.parametrize("n", [0, 1, 2, 19, 20, 21, 100, 400])
def test_statistics_against_loops(spark, entries, n):
    rng = random.Random(n)
    rows = [
        dict(
            level=rng.choice(["info", "error", "fatal", "Error", "warn"]),
            status=rng.choice([None, 200, 404, 503]),
            path=rng.choice([None, "/hot", "/hot", "/a", "/b", "/c", "/d"]),
            method=rng.choice(["GET", "get", None]),
            ip=rng.choice(["1.1.1.1", None]),
            size=rng.choice([None, 0, 70]),
            timestamp=rng.choice([None, START + timedelta(minutes=rng.randint(0, 300))]),
            response_time=rng.choice([None, rng.randint(1, 50) / 8]),
        )
        for _ in range(n)
    ]
    want = brute_stats(rows)
    parsed = entries(*rows).withColumn("parsed", F.lit(True))
    tallied = cut_lineage(lw.tally(parsed))
    doc = lw.stats_document(tallied, 4).first()
    assert doc.parsed_lines == doc.total_lines == n and doc.failed_lines == 0
    assert (doc.level_distribution or {}) == want["levels"]
    assert (doc.status_distribution or {}) == want["statuses"]
    assert (doc.errors_per_hour or {}) == want["hours"]
    assert [tuple(p) for p in doc.top_paths] == want["paths"]
    assert (doc.p95_response_time, doc.p99_response_time) == (want["p95"], want["p99"])
    assert doc.total_bytes == want["bytes"]
    e = lw.entries(parsed)
    times = lw.response_times(e).first()
    assert (times.p95_response_time, times.p99_response_time) == (want["p95"], want["p99"])
    assert [tuple(r) for r in lw.top_paths(e, 4).collect()] == want["paths"]


def test_percentiles_over_many_ranges(spark):
    counts = spark.range(10_000).select(F.col("id").cast("double").alias("value"), (F.col("id") % 3 + 1).alias("count"))
    everything = [v for v in range(10_000) for _ in range(v % 3 + 1)]
    fractions = [0.01, 0.5, 0.95, 0.99, 1.0]
    got = {r.fraction: r.value for r in lw.nearest_rank(counts.repartition(9), fractions).collect()}
    assert got == {p: float(everything[-int(-p * len(everything) // 1) - 1]) for p in fractions}


def test_csv(spark, entries, tmp_path):
    e = entries(
        dict(message='a"b,c', path="/p,q", status=200, size=0, response_time=0.0, timestamp=START, method="GET"),
        dict(message=" x ", size=2, response_time=2.0, ip="1.1.1.1"),
    )
    lines = [r.value for r in lw.csv_rows(e).collect()]
    assert lines == [
        '1,2024-01-01T00:00:00.000Z,info,200,GET,"/p,q","a""b,c",,,',
        "2,,info,,,, x ,1.1.1.1,2,2",
    ]
    lw.write_csv(e, str(tmp_path / "out"), ordered=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    rows = list(csv.DictReader(io.StringIO(text)))
    assert rows[0]["message"] == 'a"b,c' and rows[0]["size"] == "" and rows[1]["message"] == " x "


def test_json(spark, entries, tmp_path):
    e = entries(dict(message='q"\\\n', status=0, timestamp=START), dict(size=5, response_time=1.5, user_agent="u"))
    first, second = [json.loads(r.value) for r in lw.json_rows(e).collect()]
    assert first == {"line": 1, "timestamp": "2024-01-01T00:00:00.000Z", "level": "info", "message": 'q"\\\n', "source": "nginx", "status": 0}
    assert second == {"line": 2, "timestamp": None, "level": "info", "message": "m", "source": "nginx", "size": 5, "responseTime": 1.5}
    lw.write_json(e, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_parquet_days(spark, entries, tmp_path):
    e = entries(dict(timestamp=START), dict(timestamp=START + timedelta(days=1)), dict())
    lw.write_parquet(e, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("event_date = '2024-01-02'").count() == 1 and back.count() == 3


def test_preview_and_text(spark, entries):
    e = entries(
        dict(method="GET", path="/" + "p" * 50, status=200, timestamp=START),
        dict(message="m" * 81), dict(message="m" * 80), dict(method="GET"),
    )
    rows = lw.preview(e).collect()
    assert tuple(rows[0]) == (1, "2024-01-01 00:00:00", "INFO", 200, "GET", "/" + "p" * 36 + "...")
    assert [len(r.detail or "") for r in rows[1:]] == [80, 80, 0]
    assert rows[1].detail.endswith("...")
    assert has_http(e).first()[0] and not has_http(e.limit(0)).first()[0]
    one = spark.range(1)
    mark = lambda text, p, **k: one.select(highlight(spark, F.lit(text), p, **k)).first()[0]
    assert mark("Err err", "ERR") == "<<Err>> <<err>>"
    assert mark("a$b", r"\$", before="$", after="\\") == "a$$\\b"
    assert mark("a(b", "(") == "a(b" and mark("x", "") == "x"
    assert one.select(csv_field(F.lit("a\nb"))).first()[0] == '"a\nb"'
    assert one.select(truncate(F.lit("abcdef"), 5)).first()[0] == "ab..."
