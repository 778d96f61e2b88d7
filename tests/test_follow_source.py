"""The follow source by itself: places, ranges and lines, without a running stream."""

import os
import random

import pytest

from logweir.streaming import follow_rows, number_batches, view_batches
from logweir.streaming.follow_source import LogFollowReader, last_lines


class Follower:
    """A stream by hand: each drain reads what came since the last one; a restart forgets all but offsets."""

    def __init__(self, path, **options):
        self.options = {"path": str(path), "initialLines": "all", "settleSeconds": "1000"} | options
        self.restart()
        self.place = self.reader.initialOffset()

    def restart(self):
        self.reader = LogFollowReader(self.options)

    def rows(self):
        end = self.reader.latestOffset()
        parts = self.reader.partitions(self.place, end)
        self.place = end
        return [r for p in parts for b in self.reader.read(p) for r in b.to_pylist()]

    def drain(self):
        return [r["value"] for r in self.rows() if r["kind"] in ("line", "backlog")]


def write(path, text, mode="a"):
    with open(path, mode) as out:
        out.write(text)


@pytest.mark.parametrize("restart", [False, True])
@pytest.mark.parametrize("size", ["3", "1000"])
def test_each_line_once_through_rotation(tmp_path, restart, size):
    log = tmp_path / "x.log"
    follower, seen = Follower(tmp_path, rangeBytes=size), []

    def step():
        if restart:
            follower.restart()
        seen.extend(follower.drain())

    lines = iter(f"{i:04d} a line of the log that is long enough to tell files apart {i}" for i in range(100))
    put = lambda path, n=3: write(path, "".join(next(lines) + "\n" for _ in range(n)))
    put(log)
    step()
    put(log)
    os.rename(log, tmp_path / "x.log.1")  # lines that came before and after the renaming
    put(tmp_path / "x.log.1")
    put(log)
    step()
    write(tmp_path / "x.log.2", log.read_text())  # copied, then truncated in place
    put(tmp_path / "x.log.2", 1)
    os.truncate(log, 0)
    put(log, 1)
    step()
    os.remove(log)  # and made anew
    step()
    put(log)
    step()
    assert sorted(seen) == sorted(f"{i:04d} a line of the log that is long enough to tell files apart {i}" for i in range(17))


def test_unfinished_lines_wait_and_are_released(tmp_path):
    log = tmp_path / "x.log"
    write(log, "one\ntw")
    follower = Follower(log)
    assert follower.drain() == ["one"]
    write(log, "o\nthr")
    assert follower.drain() == ["two"]
    write(log, "ee is long")
    assert follower.drain() == []
    follower.reader.settle = 0
    assert follower.drain() == ["three is long"]
    assert follower.drain() == []
    follower.reader.settle = 1000
    write(log, " and goes on")
    assert follower.drain() == []
    write(log, "\nfour\n")
    assert follower.drain() == [" and goes on", "four"]


@pytest.mark.parametrize("text", ["a\nb", "a\nb\n", "", "\n\n", "x", "a\n \n\t\nlast", "é\r\n猫" * 50_000])
@pytest.mark.parametrize("size", ["5", "100000"])
def test_a_drained_file_equals_its_lines(tmp_path, text, size):
    log = tmp_path / "x.log"
    if len(text) > 1000 and size == "5":
        text = text[:999]
    log.write_bytes(text.encode())
    want = [x for x in text.split("\n") if x.strip()]
    assert Follower(log, settleSeconds="0", rangeBytes=size).drain() == want
    for n in (1, 2, 3):
        assert Follower(log, settleSeconds="0", rangeBytes=size, initialLines=str(n)).drain() == want[-n:]


def test_bytes_that_are_gone_raise(tmp_path):
    log = tmp_path / "x.log"
    write(log, "one\ntwo\n")
    for harm in (lambda: os.truncate(log, 3), lambda: os.remove(log)):
        follower = Follower(log)
        end = follower.reader.latestOffset()
        parts = follower.reader.partitions({}, end)
        harm()
        with pytest.raises(FileNotFoundError, match="onLoss"):
            [b for p in parts for b in follower.reader.read(p)]
        follower.reader.skip_loss = True
        assert not [b for p in parts for b in follower.reader.read(p)]
        write(log, "one\ntwo\n", "w")


def test_a_file_renamed_before_it_is_read(tmp_path):
    log = tmp_path / "x.log"
    write(log, "one\ntwo\n")
    follower = Follower(log)
    parts = follower.reader.partitions({}, follower.reader.latestOffset())
    os.rename(log, tmp_path / "x.log.1")
    write(log, "1\n")
    assert [v for p in parts for b in follower.reader.read(p) for v in b.column("value").to_pylist()] == ["one", "two"]


def test_unchanged_files_are_not_opened_again(tmp_path, monkeypatch):
    for i in range(5):
        write(tmp_path / f"{i}.log", f"line {i}\n")
    follower = Follower(tmp_path)
    follower.drain()
    opened = []
    monkeypatch.setattr("logweir.streaming.follow_source._head_of", lambda file, size: opened.append(file) or ("", []))
    follower.reader.latestOffset()
    assert not opened
    write(tmp_path / "3.log", "more\n")
    follower.reader.latestOffset()
    assert opened == [str(tmp_path / "3.log")]


@pytest.mark.parametrize("final", [False, True])
def test_last_lines_are_read_backward(tmp_path, final):
    rng = random.Random(4)
    for _ in range(30):
        parts = [rng.choice(["", " ", "x" * rng.randrange(1, 200_000), f"l{rng.random()}"]) for _ in range(12)]
        path = tmp_path / "x"
        path.write_text("\n".join(parts))
        complete = parts if final else parts[:-1]
        want = [p for p in complete if p.strip()]
        for n in (1, 4, 100):
            with open(path, "rb") as source:
                got = last_lines(source, path.stat().st_size, n, final)
            assert [line for _, line in got] == want[-n:]
            data = path.read_text()
            assert all(data[at : at + len(line)] == line and (at == 0 or data[at - 1] == "\n") for at, line in got)


def test_index_rows_tell_heads_and_counts(tmp_path):
    log = tmp_path / "x.log"
    write(log, "".join(f"line {i}\n\n" for i in range(100)))
    follower = Follower(log, initialLines="7", index="true", rangeBytes="50")
    rows = follower.rows()
    assert [r["value"] for r in rows if r["kind"] == "head"] == [f"line {i}" for i in range(5)]
    assert sum(r["ordinal"] for r in rows if r["kind"] == "count") == 100
    assert [r["value"] for r in rows if r["kind"] == "backlog"] == [f"line {i}" for i in range(93, 100)]
    write(log, "new\n")
    rows = follower.rows()
    assert [(r["kind"], r["value"]) for r in rows][-1] == ("line", "new") and not any(r["kind"] == "count" for r in rows)


def drain(spark, tmp_path, run, **options):
    rows = follow_rows(spark, str(tmp_path / "in"), **options)
    query = rows.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "checkpoint"))
    query.trigger(availableNow=True).start().awaitTermination()


def test_numbers_and_formats_over_many_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    access = '10.1.2.3 - - [05/Mar/2023:10:00:00 +0000] "GET /p{} HTTP/1.1" 200 5 "-" "agent"\n'
    write(tmp_path / "in" / "a.log", "".join(access.format(i) for i in range(30)))
    write(tmp_path / "in" / "b.log", "")
    seen = {}

    def keep(rows, batch_id):
        seen.update({(os.path.basename(r.file), r.line): (r.method, r.detail) for r in rows.collect()})

    run = view_batches(str(tmp_path / "state"), keep)
    drain(spark, tmp_path, run, initial_lines=2, range_bytes=700)
    assert seen == {("a.log", 29): ("GET", "/p28"), ("a.log", 30): ("GET", "/p29")}
    for i in range(30, 35):
        write(tmp_path / "in" / "a.log", access.format(i))
        write(tmp_path / "in" / "b.log", f"[WARN] number {i}\n")
        drain(spark, tmp_path, run, initial_lines=2)
    assert {k[1]: v for k, v in seen.items() if k[0] == "a.log"} == {i + 1: ("GET", f"/p{i}") for i in range(28, 35)}
    assert {k[1]: v for k, v in seen.items() if k[0] == "b.log"} == {i - 29: (None, f"number {i}") for i in range(30, 35)}
    assert len(os.listdir(tmp_path / "state")) == 3  # of six batches


def test_lost_state_is_an_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.log", "one\n")
    drain(spark, tmp_path, number_batches(str(tmp_path / "state"), lambda rows, _: rows.count()), initial_lines="all")
    write(tmp_path / "in" / "a.log", "two\n")
    with pytest.raises(Exception, match="line numbers cannot go on"):
        drain(spark, tmp_path, number_batches(str(tmp_path / "other"), lambda rows, _: rows.count()), initial_lines="all")
