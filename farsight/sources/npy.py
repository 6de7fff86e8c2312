"""NumPy arrays of vectors as a Spark data source: `spark.read.format("npy_vectors").load(path)` and `.write.format("npy_vectors").save(path)`.

A path is one two-dimensional .npy file, or a folder with parts and a manifest.json that lists them. Tasks read ranges of rows: each opens
the file by its URI, on any file system that Arrow knows, and reads no other byte but the header. Writing tasks write a part each and hand its name and
shape to the driver; the manifest is written only if all succeeded, so a folder without one is not a dataset.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, MANIFEST = "npy_vectors", "manifest.json"
#: Rows that one partition reads, and rows of an Arrow batch.
ROWS, BATCH = 65_536, 4096


def _open(path: str):
    """A file system and the path in it; paths without a scheme are local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _header(stream) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and the offset of the values of a .npy file."""
    version = np.lib.format.read_magic(stream)
    shape, by_column, dtype = np.lib.format.read_array_header_1_0(stream) if version == (1, 0) else np.lib.format.read_array_header_2_0(stream)
    if len(shape) != 2 or by_column:
        raise ValueError("vectors are a two-dimensional array in row order")
    return shape, dtype, stream.tell()


@dataclass
class RowRange(InputPartition):
    """Rows [start, end) of one file, whose first row is number `base` of all."""

    path: str
    base: int
    start: int
    end: int


class NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def _parts(self) -> list[tuple[str, int]]:
        system, path = _open(self.path)
        if system.get_file_info(path).type == fs.FileType.File:
            with system.open_input_file(path) as f:
                return [(self.path, _header(f)[0][0])]
        where = f"{path.rstrip('/')}/{MANIFEST}"
        if system.get_file_info(where).type != fs.FileType.File:
            raise ValueError(f"no {MANIFEST} in {self.path}: it was not written to its end")
        with system.open_input_file(where) as f:
            return [(f"{self.path.rstrip('/')}/{p['name']}", p["rows"]) for p in json.loads(f.read())["parts"]]

    def partitions(self) -> list[RowRange]:
        out, base = [], 0
        for path, n in self._parts():
            out += [RowRange(path, base, a, min(n, a + self.rows)) for a in range(0, n, self.rows)]
            base += n
        return out

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        system, path = _open(partition.path)
        with system.open_input_file(path) as f:
            (_, dim), dtype, offset = _header(f)
            for a in range(partition.start, partition.end, BATCH):
                n = min(BATCH, partition.end - a)
                f.seek(offset + a * dim * dtype.itemsize)
                x = np.frombuffer(f.read(n * dim * dtype.itemsize), dtype).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim)[: n + 1].astype(np.int32) if dim else np.zeros(n + 1, np.int32)), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.base + a, partition.base + a + n)), lists], ["vec_id", "embedding"])


@dataclass
class PartWritten(WriterCommitMessage):
    name: str
    rows: int
    dim: int


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        if "embedding" not in schema.names:
            raise ValueError("a column `embedding` is written")
        self.path, self.run = path, uuid.uuid4().hex
        system, where = _open(path)
        if system.get_file_info(f"{where.rstrip('/')}/{MANIFEST}").type == fs.FileType.File:
            if not overwrite:
                raise ValueError(f"{path} holds a dataset already")
            system.delete_file(f"{where.rstrip('/')}/{MANIFEST}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> PartWritten:
        """One part: its values go to a temporary file as they come, as the header needs their number."""
        system, where = _open(self.path)
        system.create_dir(where, recursive=True)
        name = f"part-{self.run}-{uuid.uuid4().hex}.npy"
        rows, dim, temporary = 0, None, f"{where.rstrip('/')}/.{name}.values"
        with system.open_output_stream(temporary) as out:
            for batch in batches:
                lists = batch.column("embedding")
                sizes = set(lists.value_lengths().to_pylist())
                if lists.null_count or len(sizes | ({dim} - {None})) > 1:
                    raise ValueError("vectors are not null and of one size")
                if batch.num_rows:
                    dim, rows = sizes.pop(), rows + batch.num_rows
                    out.write(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), np.float32).tobytes())
        with system.open_output_stream(f"{where.rstrip('/')}/{name}") as out, system.open_input_stream(temporary) as values:
            np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (rows, dim or 0)})
            while chunk := values.read(1 << 22):
                out.write(chunk)
        system.delete_file(temporary)
        return PartWritten(name, rows, dim or 0)

    def commit(self, messages: list[PartWritten | None]) -> None:
        parts = [m for m in messages if m is not None and m.rows]
        if len({m.dim for m in parts}) > 1:
            self.abort(messages)
            raise ValueError("vectors of different sizes")
        system, where = _open(self.path)
        system.create_dir(where, recursive=True)
        text = json.dumps({"format": FORMAT, "version": 1, "rows": sum(m.rows for m in parts), "dim": parts[0].dim if parts else 0, "parts": [{"name": m.name, "rows": m.rows} for m in parts]}, indent=2)
        with system.open_output_stream(f"{where.rstrip('/')}/.{MANIFEST}.{self.run}") as out:
            out.write(text.encode())
        system.move(f"{where.rstrip('/')}/.{MANIFEST}.{self.run}", f"{where.rstrip('/')}/{MANIFEST}")

    def abort(self, messages: list[PartWritten | None]) -> None:
        system, where = _open(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{where.rstrip('/')}/{m.name}")


class NpyVectors(DataSource):
    """The data source; the option `rows` sets how many rows a partition reads."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "vec_id long, embedding array<float>"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("rows", ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(NpyVectors)
