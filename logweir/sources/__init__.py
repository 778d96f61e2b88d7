"""Lines from text files and from tables."""

from logweir.sources.heads import read_heads
from logweir.sources.lines import read_lines
from logweir.sources.tables import lines_from_table

__all__ = ["lines_from_table", "read_heads", "read_lines"]
