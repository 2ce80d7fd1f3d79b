"""What the operators share: reading tables, checkpoints, byte views of text columns, splitting by ranges of an id."""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one task or one group is meant to hold, and that one row of a shuffle of packed rows holds.
BLOCK_BYTES, PIECE_BYTES = 16 << 20, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: what the session names in spark.checkpoint.dir, else one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = at.get() if at.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def saved(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, with the lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Returns memory that is free to the machine: a worker serves later stages too, beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of a group's rows that gives memory back after each group."""

    def each(rows: pa.Table) -> pa.Table:
        out = run(rows)
        give_back()
        return out

    return each


def lean_pair(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for two cogrouped frames."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        give_back()
        return out

    return each


def remainder(column: str, n: int) -> F.Column:
    """crc32(column as text) mod n; null if the column is null."""
    return F.crc32(F.col(column).cast("string")) % n


def blocks_for(df: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """How many groups of about block_bytes the column's bytes make; at least the session's shuffle partitions."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / block_bytes))


def chunks(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about limit bytes. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = min(len(column), max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over each row's slice; 0 for an empty row."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0)
    return out


def by_id_ranges(df: DataFrame, key: str, text: str, block_bytes: int, least: int) -> list:
    """Ascending values of key that cut its rows into runs of about block_bytes of text, and at least about `least` runs.

    Ranges of equal counts come first, then each is cut in its sorted order wherever a run would come to hold over twice
    the bytes (long texts next to each other). Rows that share a key stay in one run, so only such a key can hold more.
    A null key is left out. The driver gets one value of each run.
    """
    sizes = df.select(key, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")).where(F.col(key).isNotNull())
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    limit = 2 * block_bytes

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, any_yet = 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, ends = keys[new], np.cumsum(np.add.reduceat(n, new))
            cuts, start, before = [] if any_yet else [0], 0, 0
            any_yet = True
            while True:
                at = int(np.searchsorted(ends, before + limit - held, "right"))
                if at == start and not held:
                    at += 1  # one key is over the limit by itself
                if at >= len(keys):
                    break
                cuts.append(at)
                held, start, before = 0, at, int(ends[at - 1]) if at else 0
            held += int(ends[-1]) - before
            if cuts:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(new[cuts]))], names=[key])

    parts = sizes.repartitionByRange(max(least, math.ceil(total / block_bytes)), key).sortWithinPartitions(key)
    return sorted({r[0] for r in parts.mapInArrow(firsts, sizes.select(key).schema).collect()})[1:]


def packed(rows: pa.Table) -> bytes:
    """Rows as one compressed block."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(blocks: pa.ChunkedArray | pa.Array) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in blocks])


def cut_by_bytes(groups: np.ndarray, sizes: np.ndarray, limit: int) -> list[int]:
    """Where blocks begin: with each new group, and before a row with which a block would hold over limit bytes."""
    edges, total = [], np.cumsum(sizes)
    starts = np.flatnonzero(np.diff(groups, prepend=-1)).tolist()
    for lo, hi in zip(starts, [*starts, len(groups)][1:], strict=True):
        while lo < hi:
            edges.append(lo)
            lo = max(lo + 1, int(np.searchsorted(total, total[lo] - sizes[lo] + limit, "right")))
    return edges


def dealt_by_ranges(df: DataFrame, key: str, text: str = "text", neighbours: bool = False, flush_bytes: int = 16 << 20) -> DataFrame:
    """df's rows dealt into runs of ascending key with about BLOCK_BYTES of text, as columns run (int) and block (binary, see unpacked()).

    A null key comes first. Rows travel as compressed blocks of about PIECE_BYTES of text at most (a longer text is one by
    itself), so that no row of the shuffle takes a large piece of an executor's memory. With neighbours, the
    rows of each run's first key are also sent to the run before (of the first run: to the last), marked in the added
    column `next_run`.
    """
    cuts = by_id_ranges(df, key, text, BLOCK_BYTES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    firsts = [None, *cuts]
    if neighbours:
        has_null = df.where(F.col(key).isNull()).limit(1).count() > 0
        firsts[0] = None if has_null else df.agg(F.min(key)).first()[0]
    runs, bounds = len(firsts), np.array(cuts, np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            held.clear()
            at = rows.column(0).combine_chunks()
            null = at.is_null().to_numpy(zero_copy_only=False)
            ids = at.fill_null(0).to_numpy(zero_copy_only=False)
            run = np.where(null, 0, np.searchsorted(bounds, ids, "right"))
            where, tail = [np.arange(len(run))], [np.zeros(len(run), bool)]
            if neighbours:
                lead = np.array([0 if x is None else x for x in firsts], np.int64)[run]
                first = np.where(run == 0, null if firsts[0] is None else ~null & (ids == lead), ids == lead)
                where.append(np.flatnonzero(first))
                tail.append(np.ones(len(where[1]), bool))
            where, tail = np.concatenate(where), np.concatenate(tail)
            to = np.where(tail, (run[where] - 1) % runs, run[where])
            order = np.argsort(to, kind="stable")
            sizes = pc.fill_null(pc.binary_length(rows.column(text)), 0).to_numpy()[where[order]].astype(np.int64)
            edges = cut_by_bytes(to[order], sizes, PIECE_BYTES)
            for lo, hi in zip(edges, [*edges, len(order)][1:], strict=True):
                some = rows.take(pa.array(where[order[lo:hi]]))
                if neighbours:
                    some = some.append_column("next_run", pa.array(tail[order[lo:hi]]))
                yield pa.RecordBatch.from_arrays([pa.array([int(to[order[lo]])], pa.int32()), pa.array([packed(some)], pa.binary())], names=["run", "block"])

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > flush_bytes:
                yield from out()
                give_back()
                size = 0
        if held:
            yield from out()
        give_back()

    return df.select(key, *(c for c in df.columns if c != key)).mapInArrow(deal, "run int, block binary")
