"""The state store of keyed state, and rows packed into its values."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTITIONS = "spark.sql.shuffle.partitions"


@contextmanager
def on_rocksdb(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which spills to disk and is saved to the checkpoint; others are left alone.

    ``partitions`` is the most partitions of state of a new stream: each costs some tenths of a second a batch, be it empty.
    """
    settings = {_PROVIDER: _ROCKSDB}
    if partitions is not None:
        settings[_PARTITIONS] = str(min(partitions, int(spark.conf.get(_PARTITIONS))))
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


# Rows of one packed value: what waits is kept in values of some MB at most, however much there is.
PACK_ROWS = 50_000


def packed(rows: pa.Table) -> list[tuple[bytes]]:
    """Values of a binary list state that hold the rows as Arrow streams, so that a call moves many rows, not one."""
    out = []
    for start in range(0, rows.num_rows, PACK_ROWS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_table(rows.slice(start, PACK_ROWS))
        out.append((sink.getvalue().to_pybytes(),))
    return out


def unpacked(values: Iterable[tuple[bytes]], schema: pa.Schema) -> pa.Table:
    """The rows of :func:`packed` values, in the order in which they were added."""
    return pa.concat_tables([schema.empty_table(), *[pa.ipc.open_stream(bytes(value)).read_all() for (value,) in values]])
