"""Matrices in .npy files as a data source, and written by tasks.

    spark.dataSource.register(npy.NpySource)
    spark.read.format("npy").load(path)      # row, vector

A file is cut by ranges of rows, each read by a task of its own; rows are numbered
by their place. A folder of files, as `write_npy` leaves it, is one matrix in the
order of the files' names. Paths may name any store that Arrow's file systems open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that one task reads.
PART_BYTES = 32 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and where the numbers begin."""
    store, name = _opened(path)
    with store.open_input_file(name) as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if fortran and len(shape) > 1:
            raise ValueError(f"{path}: columns come first; save it in C order")
        if kind.hasobject:
            raise ValueError(f"{path}: holds objects")
        return shape, kind, f.tell()


def files_of(path: str) -> list[str]:
    store, name = _opened(path)
    if store.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    found = [i.path for i in store.get_file_info(fs.FileSelector(name)) if i.base_name.endswith(".npy") and not i.base_name.startswith(("_", "."))]
    return [f"{path.rstrip('/')}/{p.rsplit('/', 1)[-1]}" for p in sorted(found)]


class Rows(InputPartition):
    def __init__(self, path: str, first: int, rows: int, number: int):
        self.path, self.first, self.rows, self.number = path, first, rows, number


class NpySource(DataSource):
    """(row, vector) of a matrix, or of a list of numbers as vectors of one."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row long, vector array<double>"

    def reader(self, schema) -> NpyReader:  # noqa: ANN001
        return NpyReader(self.options["path"], int(self.options.get("partBytes", PART_BYTES)))


class NpyReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def partitions(self) -> list[Rows]:
        out, number = [], 0
        for path in files_of(self.path):
            shape, kind, _ = header(path)
            step = max(1, self.part_bytes // max(1, kind.itemsize * math.prod(shape[1:])))
            out += [Rows(path, first, min(step, shape[0] - first), number + first) for first in range(0, shape[0], step)]
            number += shape[0]
        return out or [Rows("", 0, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        shape, kind, begin = header(part.path)
        width = math.prod(shape[1:])
        store, name = _opened(part.path)
        with store.open_input_file(name) as f:
            f.seek(begin + part.first * width * kind.itemsize)
            step = max(1, (4 << 20) // max(1, width * kind.itemsize))
            for at in range(0, part.rows, step):
                n = min(step, part.rows - at)
                values = np.frombuffer(f.read(n * width * kind.itemsize), kind).astype(np.float64)
                vectors = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, values)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + part.number + at), vectors], ["row", "vector"])


def write_npy(df: DataFrame, path: str, vector: str, order: list[str], kind: str = "<f4") -> int:
    """Writes the vectors, in that order, as files part-00000.npy, part-00001.npy, .. of one matrix; how many there are.

    A file is complete when it gets its name, so a task that runs again replaces it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        rows = [np.array(x, kind) for batch in batches for x in batch.column(0).to_pylist()]
        if rows:
            store, folder = _opened(path)
            store.create_dir(folder, recursive=True)
            held, name = f"{folder}/_{task.partitionId()}-{task.taskAttemptId()}", f"{folder}/part-{task.partitionId():05d}.npy"
            with store.open_output_stream(held) as f:
                np.lib.format.write_array_header_1_0(f, {"descr": np.dtype(kind).str, "fortran_order": False, "shape": (len(rows), len(rows[0]))})
                for row in rows:
                    f.write(row.tobytes())
            store.move(held, name)
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], ["n"])

    dealt = df.select(vector, *order).repartitionByRange(*order).sortWithinPartitions(*order).select(vector)
    return dealt.mapInArrow(run, "n long").agg(F.sum("n")).head()[0] or 0


def positional(matrix: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows`, numbered by `row`, with their vectors; an error where one side has a row that the other lacks."""
    met = rows.withColumn("__r", F.lit(True)).join(matrix.withColumn("__m", F.lit(True)), "row", "full")
    whole = F.when(F.col("__r") & F.col("__m"), F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("no partner for row "), F.col("row").cast("string"))))
    return met.withColumn("vector", whole).drop("__r", "__m")
