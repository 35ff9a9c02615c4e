"""Texts gathered into blocks of bounded size, one row each, for operators that ask about whole blocks.

A block gets its id when it is written, so it stays the same when a task is run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa

from wardflow.llm.octets import slices

BLOCK_BYTES = 24 << 20


def to_blocks_of(limit: int):
    """Gather rows ``(id, flag, text)`` into blocks of about ``limit`` bytes: a new id, and the rows as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, waiting[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for batch in waiting:
                    out.write_batch(batch)
            block = uuid.uuid4().int & (2**63 - 1)
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "bytes", "texts"]
            )

        for batch in batches:
            for low, high, t in slices(batch.column(2)):
                waiting.append(batch.slice(low, high - low))
                size += len(t.data) + 8 * (high - low)
                if size >= limit:
                    yield packed()
                    waiting, size = [], 0
        if waiting:
            yield packed()

    return run


def opened(texts: bytes) -> pa.Table:
    return pa.ipc.open_stream(texts).read_all()
