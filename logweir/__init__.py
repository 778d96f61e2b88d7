"""Log analytics on Spark: lines to entries, filters, statistics, exports, live follow."""

from logweir.operators import *  # noqa: F401,F403
from logweir.operators import __all__ as _operators
from logweir.schema import ENTRIES, ENTRY_COLUMNS, LINES
from logweir.session import configure
from logweir.sources import lines_from_table, read_heads, read_lines

__all__ = [
    *_operators, "ENTRIES", "ENTRY_COLUMNS", "LINES", "configure", "lines_from_table",
    "read_heads", "read_lines",
]
