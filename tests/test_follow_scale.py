"""The follow source on many files: work that grows with them, not with their square."""

import os

from logweir.streaming import follow_source
from logweir.streaming.follow_source import LogFollowReader


def follower(path, **options):
    return LogFollowReader({"path": str(path), "initialLines": "all", "settleSeconds": "1000"} | options)


def values(reader, parts):
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    return [(os.path.basename(r["file"]), r["ordinal"], r["value"]) for r in rows if r["kind"] == "line"]


def test_a_task_reads_many_small_files(tmp_path):
    want = []
    for i in range(60):
        lines = [f"line {n} of {i}" for n in range(i)]
        (tmp_path / f"{i:02}.log").write_text("".join(line + "\n\n" for line in lines))
        want += [(f"{i:02}.log", n + 1, line) for n, line in enumerate(lines)]
    reader = follower(tmp_path, index="true", rangeBytes=str(1 << 20))
    parts = reader.partitions({}, reader.latestOffset())
    assert len(parts) == 1
    assert sorted(values(reader, parts)) == sorted(want)


def test_tasks_share_the_bytes(tmp_path):
    line = "x" * 99 + "\n"
    for i in range(8):
        (tmp_path / f"{i}.log").write_text(line * 10_000)
    reader = follower(tmp_path, rangeBytes=str(64 << 10), tasks="4")
    parts = reader.partitions({}, reader.latestOffset())
    assert 4 <= len(parts) <= 8
    assert len(values(reader, parts)) == 80_000
    assert len(follower(tmp_path, tasks="1000").partitions({}, reader.latestOffset())) == 8


def test_gone_files_are_not_compared_with_each_new_one(tmp_path, monkeypatch):
    old = {f"1:{i}": {"file": f"{i}.log", "pos": 100 + i, "whole": True, "floor": 0, "head": f"{i:0128x}", "deeper": []} for i in range(200)}
    new = {f"2:{i}": {**old[f"1:{i}"], "pos": 1000} for i in range(100)}
    new |= {f"2:{i}": {**old[f"1:{i}"], "head": f"{i + 1000:0128x}"} for i in range(100, 200)}
    asked, same = [], follow_source._same
    monkeypatch.setattr(follow_source, "_same", lambda a, b: asked.append(1) or same(a, b))
    parts = follower(tmp_path).partitions(old, new)
    starts = {r.file_id: r.start for p in parts for r in p.ranges}
    assert starts == {f"2:{i}": 100 + i if i < 100 else 0 for i in range(200)}
    assert len(asked) <= 400


def test_gone_files_with_the_same_first_bytes(tmp_path):
    gone = lambda pos, deeper: {"file": "x", "pos": pos, "whole": True, "floor": 0, "head": "ab" * 64, "deeper": deeper}
    start = {"a": gone(900, ["1"]), "b": gone(500, ["2"]), "c": gone(300, ["1"]), "d": gone(400, ["1"]), "e": gone(90, [])}
    found = lambda pos, deeper: follow_source.Places(start, {}).before("new", gone(pos, deeper))["pos"]
    assert [found(p, ["1"]) for p in (1000, 899, 300, 299, 89)] == [900, 300, 300, 90, 0]
    assert [found(1000, d) for d in (["2", "3"], ["9"], [])] == [500, 90, 90]
