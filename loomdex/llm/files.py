"""Files in the shared folder, by any scheme that pyarrow opens; and text helpers for Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyarrow import fs
from pyspark.sql import SparkSession


def place(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[len("file:"):])


def put(uri: str, name: str, data: bytes) -> None:
    """Write under a name of this attempt, then move: a repeated task leaves one whole file."""
    where, root = place(uri)
    where.create_dir(root, recursive=True)
    own = f"{root}/_{name}.{os.getpid()}-{os.urandom(6).hex()}"
    with where.open_output_stream(own) as out:
        out.write(data)
    where.move(own, f"{root}/{name}")


def get(uri: str, name: str) -> bytes:
    where, root = place(uri)
    with where.open_input_file(f"{root}/{name}") as f:
        return f.read()


def give_back() -> None:
    """Returns a task's freed memory to the system: a worker that waits for its next stage holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def driver_gives_back(spark: SparkSession) -> None:
    """The driver drops what finished steps leave (plans, broadcasts, compiled code) and returns freed memory to the system: Python's, the
    heap's beyond the JVM's least share of free room, and what native code freed in the arenas of hundreds of threads. Results stay."""
    gc.collect()
    give_back()
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def array(kind, values):
        out = new(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    def call(bean: str, operation: str, *args: str):
        """By the interface: the server's own class is not exported to Py4J."""
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        kinds = array(jvm.java.lang.String, ["java.lang.String"] * len(args))
        name = jvm.javax.management.ObjectName(f"com.sun.management:type={bean}")
        return invoke.invoke(server, array(jvm.java.lang.Object, [name, operation, array(jvm.java.lang.Object, args), kinds]))

    free = "MaxHeapFreeRatio"
    try:
        least, most = (call("HotSpotDiagnostic", "getVMOption", x).get("value") for x in ("MinHeapFreeRatio", free))
        call("HotSpotDiagnostic", "setVMOption", free, least)
        try:
            jvm.System.gc()
        finally:
            call("HotSpotDiagnostic", "setVMOption", free, most)
        call("DiagnosticCommand", "systemTrimNativeHeap")
    except Py4JError:
        pass  # another JVM


def quoted(name: str) -> str:
    """A column's name as an expression, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores before it until no column has it in either case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def plain(column: pa.Array | pa.ChunkedArray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """One chunk of the given kind with 64-bit offsets folded away; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("" if pa.types.is_string(column.type) else b"").cast(kind)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary array without nulls."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    got = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return got, ends - ends[0]


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a row is never split."""
    out, first, total = [], 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > first and total + s > most:
            out.append((first, i))
            first, total = i, 0
        total += s
    if len(sizes) > first:
        out.append((first, len(sizes)))
    return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of ragged pieces, laid end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
