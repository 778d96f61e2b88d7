"""First lines of files, read without scanning the rest of them."""

from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.text import WHITE_SPACE
from logweir.schema import LINES
from logweir.session import configure

_CHUNK = 1 << 16


def _open(uri: str):
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        system, path = fs.LocalFileSystem(), unquote(parsed.path)
    else:
        system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path, compression="detect")


def _first_lines(uri: str, n: int) -> list[str]:
    found, rest = [], b""
    with _open(uri) as stream:
        while len(found) < n:
            chunk = stream.read(_CHUNK)
            *whole, rest = (rest + chunk).split(b"\n")
            if not chunk:
                whole, rest = [rest], b""
            texts = (line.decode("utf-8", "replace") for line in whole)
            found += [text for text in texts if text.strip(WHITE_SPACE)]
            if not chunk:
                break
    return found[:n]


def read_heads(spark: SparkSession, paths: str | Sequence[str], n: int) -> DataFrame:
    """The first ``n`` non-blank lines of each file, numbered from 1.

    Spark's text scan reads a file to its end even if the first lines answer the question.
    Here a task opens its files one by one and stops early, so looking at the heads of 100 TB
    costs a few kilobytes per file. Listing is Spark's; file contents are not loaded by it.
    """
    configure(spark)
    paths = paths if isinstance(paths, str) else list(paths)
    listed = spark.read.format("binaryFile").load(paths)
    files = listed.select(F.col("_metadata.file_path").alias("file"))

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["file"]:
                lines = _first_lines(uri, n)
                yield pd.DataFrame(
                    {"file": uri, "line_number": range(1, len(lines) + 1), "value": lines},
                    columns=["file", "line_number", "value"],
                )

    return files.mapInPandas(heads, LINES)
