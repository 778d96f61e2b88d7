from datetime import datetime

import pytest
from pyspark.sql import functions as F

COMBINED = '203.0.113.7 - ana [03/Feb/2022:04:05:06 +0530] "PUT /shelf/42?full=1 HTTP/2.0" 204 71 "https://shop.test/cart" "Reader/9.1 (x; y)"'
COMMON = '203.0.113.7 - ana [03/Feb/2022:04:05:06 +0530] "PUT /shelf/42?full=1 HTTP/2.0" 204 71'
NGINX = '198.51.100.23 - kim [03/Feb/2022:04:05:06 +0000] "PATCH /orders/9/lines HTTP/1.1" 202 1024 "-" "Robot 3"'
NGINX_ERROR = '2022/02/03 04:05:06 [error] 77#8: *5 upstream timed out while reading, client: 203.0.113.9'
AT = datetime(2022, 2, 3, 4, 5, 6)
NO_HTTP = dict(ip=None, method=None, path=None, status=None, size=None, user_agent=None, response_time=None)


def check(row, **expected):
    assert {k: row[k] for k in expected} == expected


def test_apache_combined(parse):
    (row,) = parse("apache", COMBINED)
    check(
        row, parsed=True, line_number=1, timestamp=AT, level="info", source="apache",
        message="PUT /shelf/42?full=1 HTTP/2.0", ip="203.0.113.7", method="PUT", path="/shelf/42?full=1",
        status=204, size=71, user_agent="Reader/9.1 (x; y)", response_time=None, raw=COMBINED,
        format="apache",
    )


def test_apache_common_and_offset(parse):
    (row,) = parse("apache", COMMON, honor_offset=True)
    check(row, user_agent=None, status=204, size=71, timestamp=datetime(2022, 2, 2, 22, 35, 6))


def test_apache_levels_and_dash(parse):
    line = '192.0.2.1 - eve [03/Feb/2022:04:05:06 +0100] "HEAD /x HTTP/1.0" {} {}'
    rows = parse("apache", *[line.format(s, 100) for s in (200, 304, 404, 500, 100)], line.format(304, "-"))
    assert [r["level"] for r in rows] == ["info", "info", "warn", "error", "debug", "info"]
    assert rows[-1]["size"] == 0


def test_apache_edges(parse):
    rows = parse(
        "apache",
        "nothing of that kind",
        '- - - [31/Feb/2022:04:05:06 +0000] "" 200 5',
        '1.1.1.1 - - [03/feb/2022:04:05:06 +0000] "GET" 200 5',
        '1.1.1.1 - - [x 03/Feb/2022:04:05:06] "GET /a  b" 200 5 "unclosed',
        '﻿ 1.1.1.1　- - [03/Feb/2022:04:05:06 +0000] "GET / HTTP/1.1" 200 5\r',
    )
    check(rows[0], parsed=False, level=None, raw="nothing of that kind")
    check(rows[1], ip=None, method=None, path=None, timestamp=None, message=rows[1]["raw"])
    check(rows[2], method="GET", path=None, timestamp=None)
    check(rows[3], timestamp=AT, path="/a", user_agent=None)
    check(rows[4], ip="1.1.1.1", status=200, timestamp=AT)


def test_blank_lines_are_no_lines(parse):
    for format in ("apache", "nginx", "json", "custom"):
        assert parse(format, "", "   ", "\t ") == []


def test_nginx(parse):
    access, error, junk, timed, forwarded = parse(
        "nginx", NGINX, NGINX_ERROR, "neither of them", NGINX + " 0.123", NGINX + ' "-"'
    )
    check(
        access, source="nginx", ip="198.51.100.23", method="PATCH", path="/orders/9/lines", status=202,
        size=1024, level="info", user_agent="Robot 3", response_time=None, timestamp=AT,
    )
    check(
        error, source="nginx-error", level="error", timestamp=AT, **NO_HTTP,
        message="upstream timed out while reading, client: 203.0.113.9",
    )
    assert not junk["parsed"]
    assert timed["response_time"] == 0.123
    assert forwarded["response_time"] is None


def test_json_fields(parse):
    rows = parse(
        "json",
        '{"level":"info","message":"kettle on","timestamp":"2022-02-03T04:05:06.000Z"}',
        '{"level":30,"msg":"parcel in","time":1643861106000}',
        '{"level":"info","message":"m","method":"COPY","path":"/d/e","status":207,"ip":"2001:db8::5"}',
        '{"level":"warning","message":"low ink"}',
        '{"level":"info","msg":"s","time":1643861106}',
        '{"req":{"method":"GET","url":"/u","headers":{"user-agent":"x y"}},"res":{"statusCode":"404 NF","contentLength":7},"size":0,"duration":"12.5ms"}',
        '{"req":"text","httpMethod":"PUT","status":"abc","elapsed":0,"ip":"","clientIp":"c"}',
    )
    check(rows[0], level="info", message="kettle on", source="json", timestamp=AT, **NO_HTTP)
    check(rows[1], level="info", message="parcel in", timestamp=AT)
    check(rows[2], method="COPY", path="/d/e", status=207, ip="2001:db8::5", timestamp=None)
    assert rows[3]["level"] == "warn"
    assert rows[4]["timestamp"] == AT
    check(rows[5], method="GET", path="/u", user_agent="x y", status=404, size=7, response_time=12.5)
    check(rows[6], method="PUT", path=None, status=None, response_time=None, ip="c")


def test_json_validity(parse):
    values = [
        "no object", "[4, [5]]", '"text"', "null", '{"a":1}{"b":2}', '{"a":1} x}', "{'a':1}",
        '{"a":NaN}', '{"a":1}] [{"b":2}', '{"a":1}, {"b":2}', '{"a":1,}',
    ]
    assert [r["parsed"] for r in parse("json", *values)] == [False] * len(values)
    good = ['{"a":[1,2]}', "{}", ' {"a":{"b":[{}]}} ']
    assert [r["parsed"] for r in parse("json", *good)] == [True] * 3


def test_json_levels(parse):
    cases = {
        '{"level":35}': "level-35", '{"level":30.0}': "info", '{"level":"30"}': "30", "{}": "info",
        '{"level":"CRIT "}': "fatal", '{"level":"","severity":"Notice"}': "info",
        '{"level":0,"log_level":0}': "level-0", '{"log_level":""}': "", '{"level":false,"log_level":false}': "false",
        '{"level":"err","severity":"debug"}': "error", '{"level":60,"level":10}': "trace",
        '{"level":35.5}': "level-35.5", '{"level":"0"}': "0",
    }
    assert [r["level"] for r in parse("json", *cases)] == list(cases.values())


def test_json_messages(parse):
    cases = {
        '{"level":"info","a":{"b":1}}': '{"a":{"b":1}}',
        '{"message":"","msg":"x"}': "",
        '{"message":null,"text":5}': "5",
        '{"msg":{"a":[1]}}': '{"a":[1]}',
        '{"z":1,"a":2,"time":3}': '{"z":1,"a":2}',
        '{"z":1,"a":2,"z":3}': '{"z":3,"a":2}',
    }
    assert [r["message"] for r in parse("json", *cases)] == list(cases.values())


def test_json_times(spark):
    from logweir import LINES, parse_lines
    from logweir.functions import iso_time

    cases = {
        '{"time":"garbage","ts":1696940136.5}': "2023-10-10T12:15:36.500Z",
        '{"timestamp":true,"date":"2024/10/10 13:55:36"}': "2024-10-10T13:55:36.000Z",
        '{"@timestamp":"Thu, 10 Oct 2024 13:55:36 GMT"}': "2024-10-10T13:55:36.000Z",
        '{"created_at":"2024-10-10T13:55:36.123456+02:00"}': "2024-10-10T11:55:36.123Z",
        '{"time":1000000000001}': "2001-09-09T01:46:40.001Z",
        '{"time":"1696940136"}': None,
        '{"time":0}': "1970-01-01T00:00:00.000Z",
        '{"time":1e99,"ts":5}': "1970-01-01T00:00:05.000Z",
    }
    rows = [("f", i, v) for i, v in enumerate(cases)]
    parsed = parse_lines(spark.createDataFrame(rows, LINES), "json")
    got = [r[0] for r in parsed.orderBy("line_number").select(iso_time(F.col("timestamp"))).collect()]
    assert got == list(cases.values())
    far = parse_lines(spark.createDataFrame([("f", 1, '{"time":1000000000000}')], LINES), "json")
    assert far.select(F.year("timestamp")).first()[0] == 33658


def test_custom_cascade(parse):
    rows = parse(
        "custom",
        "Nov  9 01:02:03 box-7 mailer[88]: queue of 12 flushed",
        "2022-02-03 04:05:06 [INFO] lamp switched on in hall 3",
        "[ERROR] no paper left in tray",
        "the pump stopped with an error code",
        "2022-02-03 04:05:06 Lamp dimmed",
        "[2022-02-03T04:05:06Z] [Warn] disk",
        "[not a time] [Warn] disk",
        "Nov 9 01:02:03 h cron: Fatal trouble",
        NGINX_ERROR,
        "a TRACE line",
    )
    check(rows[0], source="syslog:mailer", level="info", message="queue of 12 flushed", timestamp=datetime(2024, 11, 9, 1, 2, 3))
    check(rows[1], source="custom", level="info", message="lamp switched on in hall 3", timestamp=AT)
    check(rows[2], source="custom", level="error", message="no paper left in tray", timestamp=None)
    check(rows[3], source="plain", level="error", timestamp=None, **NO_HTTP)
    check(rows[4], level="lamp", message="dimmed")
    check(rows[5], level="warn", timestamp=AT)
    check(rows[6], level="warn", timestamp=None)
    check(rows[7], source="syslog:cron", level="error")
    check(rows[8], source="custom", level="error", message=NGINX_ERROR.split("] ", 1)[1])
    check(rows[9], source="plain", level="debug")


def test_user_pattern(parse):
    pattern = r"(?<timestamp>\d{4}-\d{2}-\d{2})\s+(?<level>\w+)\s+(?<message>.+)"
    row, other = parse("custom", "x 2022-02-03 ERROR the belt is loose", "no match", pattern=pattern)
    check(row, level="error", message="the belt is loose", timestamp=datetime(2022, 2, 3), source="custom")
    assert not other["parsed"]
    (row,) = parse("custom", "5 /p (z)", pattern=r"(?<status>\d+) (?:(?<path>/\S*)|-) [([](?<message>z?)[)\]]$")
    check(row, status=5, path="/p", message="z", level="info", ip=None)
    (row,) = parse("custom", "aa bb", pattern=r"(x)?(?<level>a)\k<level>")
    assert row["level"] == "a"


def test_broken_pattern_is_an_error(parse):
    with pytest.raises(ValueError):
        parse("custom", "x", pattern="(?<level>[a")


def test_auto_needs_formats(parse):
    with pytest.raises(ValueError):
        parse("auto", "x")


def test_one_pattern_per_line_and_filters_below(spark):
    """A filter on a parsed column must not bring a second copy of the pattern, and one on the
    raw line must run before the pattern."""
    import contextlib
    import io

    from logweir import LINES, filter_logs, parse_logs

    lines = spark.createDataFrame([("f", 1, COMBINED)], LINES)
    logs = filter_logs(parse_logs(lines, "apache"), statuses=[204], levels=["info"], contains="put")
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        logs.explain()
    plan = text.getvalue()
    assert plan.count("regexp_replace(") == 1
    assert plan.rindex("put") > plan.index("regexp_replace(")
    assert "Exchange" not in plan and "Python" not in plan
