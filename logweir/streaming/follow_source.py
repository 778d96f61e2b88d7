"""Streaming source ``log_follow``: lines appended to files.

Spark's own file stream reads each file once and ignores what is appended later. Here an
offset holds, for each file, the bytes reached and what tells it from another file of the same name.
Planning looks at sizes and at the first kilobyte of files that changed; lines are found by
tasks, in byte ranges. All machines must see the files under the same paths.
"""

import bisect
import glob
import hashlib
import os
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logweir.functions.text import WHITE_SPACE
from logweir.patterns import DETECTION_LINES, FOLLOW_LINES

_BLOCK = 1 << 16
_READ = 4 << 20
#: Bytes of a task that reads many ranges; what a range counts for besides its bytes.
_TASK, _TASK_LEAST, _OPENED = 16 << 20, 1 << 20, 1 << 12
#: First bytes of a file kept as they are, and lengths of which only a digest is kept.
_HEAD, _DEEPER = 64, (256, 1024)

SCHEMA = "file string, file_id string, kind string, range_start bigint, byte_offset bigint, ordinal bigint, value string"
_ARROW = pa.schema([(name, pa.int64() if kind == "bigint" else pa.string()) for name, kind in (f.split() for f in SCHEMA.split(", "))])


class LogFollowSource(DataSource):
    """Rows of kind ``line`` are non-blank lines; ``ordinal`` counts those of a byte range.

    Options:

    * ``path``: file, folder or glob.
    * ``initialLines``: how many non-blank lines of each file present at the start come first
      (kind ``backlog``), or ``all``.
    * ``rangeBytes``: lines are counted in ranges of so many bytes, of which a task reads one or many.
    * ``tasks``: how many tasks a batch has at least, if there is a megabyte for each.
    * ``settleSeconds`` (60): an unfinished last line is released when its file has been still for so
      long; what is appended to it afterwards is a line of its own.
    * ``onLoss``: ``fail``, or ``skip`` to go on without bytes that are gone before they were read.
    * ``index``: also rows of kind ``head``, the first lines of each file with new bytes, and
      ``count``, the number of non-blank lines (``ordinal``) of each range before a backlog's end.

    A file keeps its place when it is renamed, and begins anew when it is rewritten in place. It
    is known by device and inode together with its first bytes; if these pass to another inode
    (a copy before truncation, a move to another disk), the copy goes on where the file was, given
    that at least 64 bytes tell so.
    """

    @classmethod
    def name(cls) -> str:
        return "log_follow"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> "LogFollowReader":
        return LogFollowReader(self.options)


@dataclass
class ByteRange:
    """Lines that end in ``[start, stop)``, or another ``kind`` of rows."""

    file: str
    file_id: str
    head: str
    start: int
    stop: int
    kind: str = "line"
    #: The range begins with a line; else its first line begins before, but not before ``floor``.
    at_line_start: bool = True
    floor: int = 0
    #: What follows the last line end counts as a line.
    final: bool = False
    #: Lines of a backlog, or of a head.
    lines: int = 0

    @property
    def cost(self) -> int:
        """About the bytes that are read."""
        return _OPENED + min(self.stop - self.start, _BLOCK if self.kind in ("head", "backlog") else self.stop)


@dataclass
class RangeGroup(InputPartition):
    """A task: ranges read one after the other."""

    ranges: list[ByteRange]


class LogFollowReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.initial = str(options.get("initialLines", FOLLOW_LINES))
        self.range_bytes = int(options.get("rangeBytes", 16 << 20))
        self.tasks = int(options.get("tasks", 1))
        self.settle = float(options.get("settleSeconds", 60))
        self.skip_loss = str(options.get("onLoss", "fail")).lower() == "skip"
        self.index = str(options.get("index", "false")).lower() == "true"
        self.reached: dict[str, dict] = {}
        self.looked: dict[str, tuple] = {}

    def _files(self) -> list[str]:
        found = []
        for path in glob.glob(self.path):
            if os.path.isdir(path):
                found += [
                    os.path.join(folder, name)
                    for folder, _, names in os.walk(path)
                    for name in names
                    if not name.startswith((".", "_"))
                ]
            else:
                found.append(path)
        return sorted(found)

    def _look(self, file: str) -> tuple[str, dict]:
        """Identity and place of a file; only a file that changed is opened, for its first bytes."""
        stat = os.stat(file)
        file_id = f"{stat.st_dev}:{stat.st_ino}" if stat.st_ino else file
        state = (file, stat.st_size, stat.st_mtime_ns)
        if self.looked.get(file_id, (None,))[0] != state:
            self.looked[file_id] = (state, _head_of(file, stat.st_size))
        head, deeper = self.looked[file_id][1]
        still = time.time() - stat.st_mtime >= self.settle
        return file_id, {"file": file, "pos": stat.st_size, "whole": still, "floor": 0, "head": head, "deeper": deeper}

    def _present(self) -> dict[str, dict]:
        present = {}
        for file in self._files():
            try:
                file_id, entry = self._look(file)
            except FileNotFoundError:
                continue
            present[file_id] = entry
        return present

    def initialOffset(self) -> dict:
        if self.initial == "all":
            return {}
        return {k: {**entry, "last": int(self.initial)} for k, entry in self._present().items()}

    def latestOffset(self) -> dict:
        # A file that is missing for now keeps its place, as long as the stream runs.
        latest = {k: v for k, v in self.reached.items()}
        for file_id, entry in self._present().items():
            before = self.reached.get(file_id)
            if before and _same(before, entry):
                entry["floor"] = before["pos"] if before["whole"] else before["floor"]
                if before["pos"] == entry["pos"]:
                    entry["floor"], entry["whole"] = before["floor"], before["whole"] or entry["whole"]
            latest[file_id] = entry
        return dict(sorted(latest.items()))

    def partitions(self, start: dict, end: dict) -> list[RangeGroup]:
        ranges, places = [], Places(start, end)
        for file_id, now in end.items():
            ranges += self._ranges(file_id, places.before(file_id, now), now)
        self.reached = {k: {name: v for name, v in entry.items() if name != "last"} for k, entry in end.items()}
        return _grouped(ranges, self.tasks)

    def _ranges(self, file_id: str, before: dict, now: dict) -> Iterator[ByteRange]:
        first, stop = before["pos"], now["pos"]
        last, ended = before.get("last"), now["whole"] and (stop > first or not before["whole"] or "last" in before)
        own = {"file": now["file"], "file_id": file_id, "head": now["head"]}
        if self.index and (stop > first or last or ended):
            yield ByteRange(**own, start=0, stop=stop, kind="head", final=now["whole"], lines=DETECTION_LINES)
        floor = 0
        if last is None:
            whole, floor = before["whole"], first if before["whole"] else before["floor"]
        else:
            whole = ended and stop == first  # an unfinished line belongs to the backlog if it is not waited for
            if last:
                yield ByteRange(**own, start=0, stop=first, kind="backlog", final=whole, lines=last)
            for at in range(0, first, self.range_bytes) if self.index else ():
                upto = min(at + self.range_bytes, first)
                yield ByteRange(**own, start=at, stop=upto, kind="count", at_line_start=at == 0, final=whole and upto == first)
            if whole:
                return
        starts = range(first, stop, self.range_bytes) if stop > first else [first] if ended and not whole else []
        for at in starts:
            upto = min(at + self.range_bytes, stop)
            yield ByteRange(
                **own, start=at, stop=upto, at_line_start=whole and at == first, floor=floor, final=now["whole"] and upto == stop)

    def read(self, partition: RangeGroup) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in (b for one in partition.ranges for b in self._rows_of(one) if b.num_rows):
            held.append(batch)
            size += batch.nbytes
            if size >= _READ:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def _rows_of(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        source = _open(partition)
        if source is None:
            if self.skip_loss:
                return
            raise FileNotFoundError(
                f"{partition.file} is gone or shorter than the {partition.stop} bytes that were to be read; "
                "set onLoss to skip to go on without them")  # fmt: skip
        with source:
            if partition.kind == "backlog":
                lines = last_lines(source, partition.stop, partition.lines, partition.final)
                yield _batch(partition, lines, 0, -1)
                return
            if partition.kind == "count":
                found = sum(sum(1 for _, line in part if line.strip(WHITE_SPACE)) for part in _parts(source, partition))
                yield _rows(partition, partition.start, [partition.start], [found], [None])
                return
            done = 0
            for part in _parts(source, partition):
                batch = _batch(partition, part, done, partition.start)
                done += batch.num_rows
                if partition.kind == "head" and done >= partition.lines:
                    yield batch.slice(0, batch.num_rows - (done - partition.lines))
                    return
                if batch.num_rows:
                    yield batch


def _head_of(file: str, size: int) -> tuple[str, list[str]]:
    """First bytes of a file below ``size``: some in hex, digests of longer beginnings."""
    with open(file, "rb") as source:
        data = source.read(min(size, max(_DEEPER)))
    return data[:_HEAD].hex(), [hashlib.blake2b(data[:n], digest_size=8).hexdigest() for n in _DEEPER if n <= len(data)]


def _same(before: dict, now: dict) -> bool:
    """Whether a file can have grown from one place to the other."""
    return (
        now["pos"] >= before["pos"]
        and now["head"].startswith(before["head"])
        and now["deeper"][: len(before["deeper"])] == before["deeper"]
    )


class Places:
    """Where files were left: by their identity, else by their first bytes if their file is gone.

    Places of files that are gone are told by all first bytes and digests they have. Of those that
    have them in common, in order of identity, one is kept if it is lower than all before it: the
    first not above some place is among these.
    """

    def __init__(self, start: dict, end: dict) -> None:
        self.start: dict[str, dict] = start
        self.gone: dict[tuple, list[tuple[int, str]]] = {}
        for other, entry in sorted(start.items()):
            if len(entry["head"]) == 2 * _HEAD and (other not in end or not _same(entry, end[other])):
                lower = self.gone.setdefault((entry["head"], *entry["deeper"]), [])
                if not lower or entry["pos"] < -lower[-1][0]:
                    lower.append((-entry["pos"], other))

    def before(self, file_id: str, now: dict) -> dict:
        known = self.start.get(file_id)
        if known:
            if _same(known, now):
                return known
        elif now["head"]:
            found = []
            for n in range(len(now["deeper"]) + 1):
                lower = self.gone.get((now["head"], *now["deeper"][:n]), [])
                found += lower[(at := bisect.bisect_left(lower, (-now["pos"], ""))) : at + 1]
            if found:
                return self.start[min(other for _, other in found)]
        return {"pos": 0, "whole": True, "floor": 0}


def _grouped(ranges: list[ByteRange], tasks: int) -> list[RangeGroup]:
    """Ranges in their order, dealt to tasks by their bytes."""
    share = min(_TASK, max(_TASK_LEAST, sum(r.cost for r in ranges) // max(1, tasks)))
    groups, size = [], 0
    for one in ranges:
        if not groups or size + one.cost > share:
            groups.append(RangeGroup([]))
            size = 0
        groups[-1].ranges.append(one)
        size += one.cost
    return groups


def _open(partition: ByteRange):
    """The file with the expected first bytes: under its name, or renamed in its folder."""
    head = bytes.fromhex(partition.head)
    folder = os.path.dirname(partition.file) or "."
    others = lambda: (entry.path for entry in os.scandir(folder) if entry.is_file())
    for names in (lambda: [partition.file], others):
        try:
            for name in names():
                source = open(name, "rb")
                if source.read(len(head)) == head and os.fstat(source.fileno()).st_size >= partition.stop:
                    return source
                source.close()
        except FileNotFoundError:
            continue
    return None


def _line_start(source, at: int, floor: int) -> int:
    """Where the line that holds byte ``at`` begins, not before ``floor``."""
    for start, block in _blocks_backward(source, at, floor):
        found = block.rfind(b"\n")
        if found >= 0:
            return start + found + 1
    return floor


def _parts(source, partition: ByteRange) -> Iterator[list[tuple[int, str]]]:
    """Lines that end within the range, with their offsets, a few megabytes at a time."""
    at, held = partition.start, []
    begin = at if partition.at_line_start else None
    step = _BLOCK if partition.kind == "head" else _READ
    while at < partition.stop:
        source.seek(at)
        data = source.read(min(step, partition.stop - at))
        if not data:
            break
        cut = data.rfind(b"\n") + 1
        if cut:
            if begin is None:  # only now is it known that a line ends here
                begin = _line_start(source, partition.start, partition.floor)
                source.seek(begin)
                held.insert(0, source.read(partition.start - begin))
            yield list(_lines(b"".join([*held, data[:cut]]), begin))
            begin, held = at + cut, []
        held.append(data[cut:])
        at += len(data)
    if partition.final:
        if begin is None:
            begin = _line_start(source, partition.start, partition.floor)
            source.seek(begin)
            held.insert(0, source.read(partition.start - begin))
        rest = b"".join(held)
        if rest:
            yield [(begin, rest.decode("utf-8", "replace"))]


def _lines(whole: bytes, start: int) -> Iterator[tuple[int, str]]:
    """Lines of bytes that end with a line feed, with their offsets from ``start`` on."""
    pieces = whole[:-1].split(b"\n")
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) + 1
    offsets = start + np.cumsum(sizes) - sizes
    return zip(offsets.tolist(), whole[:-1].decode("utf-8", "replace").split("\n"), strict=True)


def last_lines(source, stop: int, n: int, final: bool) -> list[tuple[int, str]]:
    """The last ``n`` non-blank lines before ``stop``, read backward in blocks.

    An unfinished line counts if ``final``. The pieces of a line are joined once, when its
    beginning is found.
    """
    found: list[tuple[int, str]] = []
    pieces: list[bytes] = []  # of the line being read, the last one first
    complete = final

    def add(offset: int) -> None:
        text = b"".join(reversed(pieces)).decode("utf-8", "replace")
        pieces.clear()
        if complete and text.strip(WHITE_SPACE):
            found.append((offset, text))

    for start, block in _blocks_backward(source, stop):
        end = len(block)
        while len(found) < n and (at := block.rfind(b"\n", 0, end)) >= 0:
            pieces.append(block[at + 1 : end])
            add(start + at + 1)
            complete, end = True, at
        if len(found) >= n:
            break
        pieces.append(block[:end])
    else:
        add(0)
    return found[:n][::-1]


def _batch(partition: ByteRange, lines: Iterable[tuple[int, str]], done: int, range_start: int) -> pa.RecordBatch:
    shown = [(offset, line) for offset, line in lines if line.strip(WHITE_SPACE)]
    offsets, values = zip(*shown, strict=True) if shown else ((), ())
    return _rows(partition, range_start, offsets, range(done + 1, done + 1 + len(shown)), values)


def _rows(partition: ByteRange, range_start: int, offsets, ordinals, values) -> pa.RecordBatch:
    n = len(values)
    columns = [
        [partition.file] * n, [partition.file_id] * n, [partition.kind] * n, [range_start] * n, offsets, ordinals, values]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, field.type) for c, field in zip(columns, _ARROW, strict=True)], schema=_ARROW
    )


def _blocks_backward(source, stop: int, floor: int = 0) -> Iterator[tuple[int, bytes]]:
    while stop > floor:
        start = max(floor, stop - _BLOCK)
        source.seek(start)
        yield start, source.read(stop - start)
        stop = start
