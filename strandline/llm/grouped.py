"""Documents dealt to groups as compressed blocks, so that moving texts costs less disk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import DataFrame

from .common import tidy

LEVEL = 3


def dealt(docs: DataFrame, groups: int, partitions: int | None = None) -> DataFrame:
    """docs with a column `pid` (0 .. groups - 1), as rows (pid, block): the rows of each group in each batch, without
    pid, as an Arrow stream compressed by zstd. All rows of a group are in one partition."""
    names = [c for c in docs.columns if c != "pid"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))
        for batch in batches:
            if not batch.num_rows:
                continue
            pid = batch.column("pid").to_numpy(zero_copy_only=False)
            order = np.argsort(pid, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], pid[order][1:] != pid[order][:-1]]))
            pids, blocks, held = [], [], 0
            for a, b in zip(at, [*at[1:], len(order)], strict=True):
                part = batch.select(names).take(pa.array(order[a:b]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                    out.write_batch(part)
                pids.append(int(pid[order[a]]))
                blocks.append(sink.getvalue().to_pybytes())
                held += len(blocks[-1])
                if held > 4 << 20:
                    yield _rows(pids, blocks)
                    pids, blocks, held = [], [], 0
            if pids:
                yield _rows(pids, blocks)

    def _rows(pids: list, blocks: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), pa.array(blocks, pa.binary())], names=["pid", "block"])

    return docs.mapInArrow(tidy(pack), "pid int, block binary").repartition(partitions or groups, "pid")


def opened(rows: pa.Table) -> pa.Table:
    """The rows of a group's blocks."""
    found = []
    for block in rows.column("block"):
        with pa.ipc.open_stream(block.as_buffer()) as stream:
            found += list(stream)
    return pa.Table.from_batches(found)
