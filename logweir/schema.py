"""Row contracts shared by all operators."""

from pyspark.sql import types as T

# One raw, non-blank line. `line_number` counts non-blank lines of a file from 1.
LINES = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("value", T.StringType()),
    ]
)

# One parsed line.
ENTRIES = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("size", T.LongType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("response_time", T.DoubleType()),
        T.StructField("raw", T.StringType()),
    ]
)

ENTRY_COLUMNS = ENTRIES.fieldNames()
FORMATS = ("apache", "nginx", "json", "custom")
