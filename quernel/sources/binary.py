"""Binary matrices as a Spark data source that is read by byte ranges and written by many tasks.

Two layouts. "floats": four letters, version 1 and the number of matrices, then for each its rows, its columns and float32 values row by row; numbers are 32-bit, little-endian.
"idx": 0x803, items, rows and columns, or 0x801 and items, big-endian and 32-bit, then a byte a value.

What is read is a file, or a folder that this source has written: pieces that, put together in the order of its manifest, are such a file. A task reads a range of rows, of either. What is
written is one matrix: each task streams its rows to a piece of its own, and only the commit, which knows all pieces, writes the header and then the manifest, so a folder without one is no result;
an abort removes what tasks have written. Stores are those of pyarrow.fs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: What files begin with.
MAGIC, VERSION, IMAGES, LABELS = b"MLCP", 1, 0x803, 0x801
MANIFEST, HEADER = "_manifest.json", "_header"
#: Bytes of a task's range, and of what it holds at once.
SPLIT, CHUNK = 32 << 20, 4 << 20
KINDS = {"floats": ("<f4", "array<float>"), "idx": ("u1", "array<smallint>")}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Rows(InputPartition):
    """n rows from byte at of a file on; they are rows first and on of a matrix. labels: the file of their labels, and where these begin."""

    path: str
    at: int
    matrix: int
    first: int
    n: int
    width: int
    labels: tuple[str, int] | None = None

    def __post_init__(self):
        self.value = None


class Found:
    """A file or a folder of pieces as one sequence of bytes; pieces: (path, bytes)."""

    def __init__(self, path: str):
        self.store, plain = opened(path)
        info = self.store.get_file_info(plain)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File:
            self.pieces = [(plain, info.size)]
        else:
            if self.store.get_file_info(f"{plain}/{MANIFEST}").type != fs.FileType.File:
                raise ValueError(f"{path} has no manifest: it was never written to its end")
            with self.store.open_input_file(f"{plain}/{MANIFEST}") as f:
                self.pieces = [(f"{plain}/{name}", size) for name, size in json.loads(f.read())]
            for name, size in self.pieces:
                if self.store.get_file_info(name).size != size:
                    raise ValueError(f"{name} is too short")
        self.size = sum(n for _, n in self.pieces)

    def ranges(self, at: int, n: int, unit: int) -> Iterator[tuple[str, int, int]]:
        """(file, byte, bytes) of n bytes from at on, no range going over pieces. All hold whole units."""
        for path, size in self.pieces:
            if at < size and n > 0:
                part = min(n, size - at)
                if part % unit:
                    raise ValueError(f"{path} ends within a row")
                yield path, at, part
                at, n = size, n - part
            at -= size
        if n > 0:
            raise ValueError("the file is too short")

    def bytes(self, at: int, n: int) -> bytes:
        out = b""
        for path, start, part in self.ranges(at, n, 1):
            with self.store.open_input_file(path) as f:
                out += f.read_at(part, start)
        return out


def layout_of(found: Found, layout: str) -> list[tuple[int, int, int]]:
    """(byte of the first value, rows, width) of each matrix; ValueError where the file isn't of the layout, or too short."""

    def numbers(at: int, n: int, kind: str) -> list[int]:
        return np.frombuffer(found.bytes(at, 4 * n), kind).tolist()

    out = []
    if layout == "floats":
        if found.bytes(0, min(4, found.size)) != MAGIC:
            raise ValueError("the file doesn't begin as one of floats")
        version, count = numbers(4, 2, "<u4")
        if version != VERSION:
            raise ValueError(f"version {version}")
        at = 12
        for _ in range(count):
            rows, width = numbers(at, 2, "<u4")
            out.append((at + 8, rows, width))
            at += 8 + 4 * rows * width
    else:
        (magic,) = numbers(0, 1, ">u4")
        if magic not in (IMAGES, LABELS):
            raise ValueError(f"begins with {magic:#x}")
        n, *shape = numbers(4, 3 if magic == IMAGES else 1, ">u4")
        width = int(np.prod(shape, dtype=np.int64))
        out.append((4 * (2 + len(shape)), n, width))
        at = out[0][0] + n * width
    if at > found.size:
        raise ValueError(f"the file is too short: {found.size} bytes of {at}")
    return out


class Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.path, self.layout, self.labels = options["path"], options.get("layout", "floats"), options.get("labels")
        self.split, self.most = int(options.get("split", SPLIT)), int(options.get("max_items", 0))
        self.kind = KINDS[self.layout][0]

    def partitions(self) -> list[Rows]:
        found, out = Found(self.path), []
        size = np.dtype(self.kind).itemsize
        matrices = layout_of(found, self.layout)
        paired = None
        if self.labels:
            own = Found(self.labels)
            (start, n, _), paired = layout_of(own, "idx")[0], own
            if n != matrices[0][1]:
                raise ValueError(f"{matrices[0][1]} images and {n} labels")
        for k, (at, rows, width) in enumerate(matrices):
            n, first, bytes_of = min(rows, self.most) if self.most else rows, 0, width * size
            if not bytes_of:
                continue
            for path, byte, part in found.ranges(at, n * bytes_of, bytes_of):
                step = max(1, self.split // bytes_of)
                for r in range(0, part // bytes_of, step):
                    held = min(step, part // bytes_of - r)
                    label = next(((p, b) for p, b, _ in paired.ranges(start + first, held, 1)), None) if paired else None
                    out.append(Rows(path, byte + r * bytes_of, k, first, held, width, label))
                    first += held
        return out

    def read(self, part: Rows | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no range at all
            return
        store, size = opened(self.path)[0], np.dtype(self.kind).itemsize * part.width
        step = max(1, CHUNK // size)
        with store.open_input_file(part.path) as f:
            for r in range(0, part.n, step):
                n = min(step, part.n - r)
                raw = f.read_at(n * size, part.at + r * size)
                if len(raw) < n * size:
                    raise ValueError(f"{part.path} is too short")
                values = np.frombuffer(raw, self.kind)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.width), pa.array(values.astype(np.float32 if self.layout == "floats" else np.int16)))
                columns = [pa.array(np.full(n, part.matrix, np.int32)), pa.array(np.arange(part.first + r, part.first + r + n)), lists]
                if self.labels:
                    with opened(self.labels)[0].open_input_file(part.labels[0]) as g:
                        columns.append(pa.array(np.frombuffer(g.read_at(n, part.labels[1] + r), np.uint8).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names=["matrix", "row_id", "v", "label"][: len(columns)])


@dataclass
class Piece(WriterCommitMessage):
    """A task's piece; name is None where the task had no rows."""

    name: str | None
    first: int = 0
    rows: int = 0
    size: int = 0


class Writer(DataSourceArrowWriter):
    """Rows (row_id, v), in the order of row_id within a task and from task to task."""

    def __init__(self, options: Mapping[str, str]):
        self.path, self.layout = options["path"], options.get("layout", "floats")
        self.shape = [int(x) for x in options["shape"].split("x")]
        self.width, self.kind = int(np.prod(self.shape)), KINDS[self.layout][0]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Piece:
        store, plain = opened(self.path)
        out, first, last, rows, name = None, 0, None, 0, f"piece-{uuid.uuid4().hex}"
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, lists = batch.column(0).to_numpy(), batch.column(1)
                if (np.diff(ids) <= 0).any() or (last is not None and ids[0] <= last):
                    raise ValueError("rows aren't in the order of row_id")
                if lists.null_count or (np.diff(lists.offsets.to_numpy()) != self.width).any():
                    raise ValueError(f"a row of another length than {self.width}")
                if out is None:
                    store.create_dir(plain, recursive=True)
                    out, first = store.open_output_stream(f"{plain}/{name}"), int(ids[0])
                values = lists.flatten().to_numpy(zero_copy_only=False)
                if self.layout == "idx" and len(values) and not (0 <= values.min() and values.max() <= 255):
                    raise ValueError("a value that is no byte")
                out.write(np.ascontiguousarray(values.astype(self.kind)).tobytes())
                last, rows = int(ids[-1]), rows + len(ids)
        except Exception:
            if out is not None:
                out.close()
                store.delete_file(f"{plain}/{name}")
            raise
        if out is None:
            return Piece(None)
        out.close()
        return Piece(name, first, rows, rows * self.width * np.dtype(self.kind).itemsize)

    def commit(self, messages: list[Piece | None]) -> None:
        store, plain = opened(self.path)
        pieces = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.first)
        rows = sum(m.rows for m in pieces)
        if rows >= 1 << 32:
            raise ValueError("too many rows for a 32-bit count")
        if self.layout == "floats":
            head = MAGIC + np.array([VERSION, 1, rows, self.width], "<u4").tobytes()
        else:
            head = np.array([IMAGES, rows, *self.shape] if len(self.shape) == 2 else [LABELS, rows], ">u4").tobytes()
        store.create_dir(plain, recursive=True)
        with store.open_output_stream(f"{plain}/{HEADER}") as f:
            f.write(head)
        with store.open_output_stream(f"{plain}/{MANIFEST}") as f:
            f.write(json.dumps([[HEADER, len(head)], *([m.name, m.size] for m in pieces)]).encode())

    def abort(self, messages: list[Piece | None]) -> None:
        store, plain = opened(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{plain}/{m.name}")


class Matrices(DataSource):
    """Options: path; layout floats or idx; split, the bytes of a task; max_items, a prefix of each matrix (0: all); labels, an idx file of labels beside one of images. To write: shape, 64 or 8x8."""

    @classmethod
    def name(cls) -> str:
        return "quernel_matrices"

    def schema(self) -> str:
        kind = KINDS[self.options.get("layout", "floats")][1]
        return f"matrix int, row_id long, v {kind}" + (", label int" if self.options.get("labels") else "")

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        store, plain = opened(self.options["path"])
        if overwrite and store.get_file_info(f"{plain}/{MANIFEST}").type == fs.FileType.File:
            store.delete_dir_contents(plain)
        elif store.get_file_info(f"{plain}/{MANIFEST}").type == fs.FileType.File:
            raise ValueError(f"{self.options['path']} exists")
        return Writer(dict(self.options))


def load(spark: SparkSession, path: str, layout: str = "floats", **options: object) -> DataFrame:
    """(matrix int, row_id long, v array), and label int where labels is given: in as many tasks as there are ranges."""
    spark.dataSource.register(Matrices)
    return spark.read.format("quernel_matrices").options(path=path, layout=layout, **options).load()


def save(df: DataFrame, path: str, shape: tuple[int, ...], layout: str = "floats", overwrite: bool = False) -> None:
    """df (row_id long, v array of numbers), written in the order of row_id by as many tasks as the session shuffles to. Rows are numbered by their place when they are read. Values are narrowed to float32 or must be bytes."""
    spark = df.sparkSession
    spark.dataSource.register(Matrices)
    ordered = df.select(F.col("row_id").cast("long").alias("row_id"), F.col("v").cast("array<double>").alias("v")).repartitionByRange("row_id").sortWithinPartitions("row_id")
    ordered.write.format("quernel_matrices").mode("overwrite" if overwrite else "append").options(path=path, layout=layout, shape="x".join(map(str, shape))).save()


def save_arrays(path: str, arrays: list[np.ndarray]) -> None:
    """A model's matrices in one file of floats, from the driver."""
    store, plain = opened(path)
    with store.open_output_stream(plain) as f:
        f.write(MAGIC + np.array([VERSION, len(arrays)], "<u4").tobytes())
        for m in arrays:
            m = np.atleast_2d(np.asarray(m, np.float64))
            f.write(np.array(m.shape, "<u4").tobytes() + np.ascontiguousarray(m.astype("<f4")).tobytes())


def load_arrays(path: str) -> list[np.ndarray]:
    """Back to the driver: a model, not data."""
    found = Found(path)
    return [np.frombuffer(found.bytes(at, 4 * rows * width), "<f4").reshape(rows, width).astype(np.float64) for at, rows, width in layout_of(found, "floats")]
