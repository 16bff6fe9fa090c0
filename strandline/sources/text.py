"""Lines of text files, by their compression."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Blocked gzip under its own extension, which Spark's readers take for plain text.
BLOCKED = (".bgz", ".bgzf")
ROWS = 20_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: a row for each line. Plain, gzip, bzip2 and other files of known extensions are read by Spark; blocked gzip
    files are streamed, a task for each file of the path."""
    if not path.endswith(BLOCKED):
        return spark.read.text(path)
    names = spark.read.format("binaryFile").load(path).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for name in batch["path"]:
                store, own = fs.FileSystem.from_uri(name) if ":" in name else (fs.LocalFileSystem(), name)
                with store.open_input_stream(own, compression=None) as file:
                    rest, inflate, raw, lines = b"", zlib.decompressobj(31), b"", []
                    while raw or (raw := file.read(1 << 20)):
                        rest += inflate.decompress(raw)
                        raw = b""
                        if inflate.eof:
                            raw, inflate = inflate.unused_data, zlib.decompressobj(31)
                        *whole, rest = rest.split(b"\n")
                        lines += whole
                        if len(lines) >= ROWS:
                            yield pd.DataFrame({"value": [x.decode() for x in lines]})
                            lines = []
                    lines += [rest] if rest else []
                    if lines:
                        yield pd.DataFrame({"value": [x.decode() for x in lines]})

    return names.mapInPandas(run, "value string")
