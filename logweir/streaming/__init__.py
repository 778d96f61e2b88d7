"""Live logs: follow growing files, and counts over the stream."""

from logweir.streaming.follow import (
    follow_lines,
    follow_rows,
    number_batches,
    stream_folder,
    tail_view,
    view_batches,
    with_lasting_format,
)
from logweir.streaming.follow_source import LogFollowSource
from logweir.streaming.live import live_counts, untimed_counts

__all__ = [
    "LogFollowSource", "follow_lines", "follow_rows", "live_counts", "number_batches", "stream_folder", "tail_view",
    "untimed_counts", "view_batches", "with_lasting_format",
]
