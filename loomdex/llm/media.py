"""Media columns: payloads kept losslessly as progressive JPEG coefficients, and full-resolution RGB tensors.

A payload is a text's bytes with zeros up to a positive multiple of 64: a byte is a coefficient, 64 bytes are a block. Byte b is
stored as b - 128 below 128 and as b - 126 from there on, so no coefficient is 0 or 1. Blocks go to 4:2:0 images one
MCU wide in MCU order (four of Y, one of Cb, one of Cr); unused blocks at the end are 0. A comment
segment holds the unpadded length. Reading accumulates the scans to coefficients, inverts the map, and for features
also inverts the transform, upsamples chroma and converts to RGB.

Cases. Null text counts as empty: 64 zero bytes. Equal texts give equal files, tensors and features (all arithmetic is in whole numbers).
Texts too long for one image (65535 lines: 24 MB) go on in further images, one after another in the media column.
Repeated rows and null ids are rows like others. An empty table gives an empty result. Kept columns are passed on by place, whatever
their names; others are not read.

The query writes the media column to the shared folder (Parquet with zstd), reads it back from there, and computes its figures from the
bytes read. Tensors are what `to_tensors` stores where they are wanted; the query keeps of each a feature alone, as three samples a
pixel of text would be three times the input on disk.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from loomdex.llm import files
from loomdex.llm import progressive as P
from loomdex.runtime import on_workers, shared_path

SAMPLING = ((2, 2), (1, 1), (1, 1))
MOST = 4095  # MCUs to an image
_TO = (np.arange(256, dtype=np.int16) - 128) + np.where(np.arange(256) >= 128, 2, 0).astype(np.int16)


def frames(n_bytes: int) -> list[int]:
    """MCUs of each image for a text's bytes."""
    blocks = max(1, -(-n_bytes // 64))
    mcus = -(-blocks // 6)
    return [MOST] * (mcus // MOST) + ([mcus % MOST] if mcus % MOST else [])


def in_mcu_order(mcus: int) -> np.ndarray:
    """Places, in an image's component order, of its blocks in MCU order. One MCU wide: Y's raster order is MCU order."""
    m = np.arange(mcus)
    return np.concatenate([4 * m[:, None] + np.arange(4), 4 * mcus + m[:, None], 5 * mcus + m[:, None]], axis=1).ravel()


def store(data: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The media of each text; texts are laid end to end."""
    sizes = np.diff(ends)
    shapes = [frames(int(s)) for s in sizes]
    mcus = np.array([m for f in shapes for m in f], np.int64)
    of = np.repeat(np.arange(len(sizes)), [len(f) for f in shapes])
    total = np.bincount(of, weights=mcus, minlength=len(sizes)).astype(np.int64) * 6 * 64
    payload = np.maximum(1, -(-sizes // 64)) * 64
    room = np.cumsum(total) - total
    flat = np.zeros(int(total.sum()), np.int16)
    flat[files.gather(room, payload)] = _TO[0]
    flat[files.gather(room, sizes)] = _TO[data]
    blocks = flat.reshape(-1, 64)
    base = (np.cumsum(mcus) - mcus) * 6
    coefs = np.empty_like(blocks)
    coefs[np.concatenate([in_mcu_order(int(m)) + b for m, b in zip(mcus, base)])] = blocks
    first = np.concatenate([[True], of[1:] != of[:-1]])
    notes = [struct.pack(">Q", int(sizes[t])) if f else b"" for t, f in zip(of, first)]
    got = P.encode(coefs, [P.layout(16, 16 * int(m), SAMPLING) for m in mcus], notes)
    out: list[list[bytes]] = [[] for _ in sizes]
    for t, g in zip(of.tolist(), got):
        out[t].append(g)
    return [b"".join(x) for x in out]


def parts_of(media: bytes) -> list[bytes]:
    """A media value's images: each ends at an end marker that another image, or nothing, follows."""
    out, at = [], 0
    while at < len(media):
        end = media.find(b"\xff\xd9", at) + 2
        while end < len(media) and media[end : end + 2] != b"\xff\xd8":
            end = media.find(b"\xff\xd9", end) + 2
        out.append(media[at:end])
        at = end
    return out


class Read:
    """Media read back: images, coefficients, and the text each belongs to."""

    def __init__(self, media: list[bytes]):
        parts = [parts_of(m) for m in media]
        self.of = np.repeat(np.arange(len(media)), [len(p) for p in parts])
        self.coefs, self.images = P.decode([x for p in parts for x in p])
        sizes = np.array([x.layout.blocks for x in self.images], np.int64)
        self.base = np.cumsum(sizes) - sizes
        self.first = np.searchsorted(self.of, np.arange(len(media)))
        self.n_bytes = [struct.unpack(">Q", self.images[i].comment)[0] for i in self.first.tolist()]

    def payloads(self) -> list[memoryview]:
        order = np.concatenate([in_mcu_order(x.layout.mcus_y) + b for x, b in zip(self.images, self.base)])
        v = self.coefs[order]
        raw = memoryview(np.where(v < 0, v + 128, v + 126).astype(np.uint8).tobytes())
        at = (self.base[self.first] * 64).tolist()
        return [raw[a : a + max(1, -(-n // 64)) * 64] for a, n in zip(at, self.n_bytes)]

    def tensors(self) -> list[np.ndarray]:
        """(height, 16, 3) of each text's images, one below the other."""
        mcus = np.array([x.layout.mcus_y for x in self.images], np.int64)
        plain = all(x.layout.sampling == SAMPLING and x.layout.width == 16 and all((q == 1).all() for q in x.quant) for x in self.images)
        if not plain:
            each = [P.tensor(self.coefs[b : b + x.layout.blocks], x) for b, x in zip(self.base, self.images)]
            return [np.concatenate([e for e, t in zip(each, self.of) if t == i]) for i in range(len(self.first))]
        order = np.concatenate([in_mcu_order(int(m)) + b for m, b in zip(mcus, self.base)])
        whole = P.samples(self.coefs[order], np.ones(64)).reshape(-1, 6, 8, 8)
        y = whole[:, :4].reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16)
        up = lambda c: np.repeat(np.repeat(c, 2, axis=1), 2, axis=2)
        full = P.rgb(y, up(whole[:, 4]), up(whole[:, 5])).reshape(-1, 16, 3)
        rows = np.concatenate([[0], np.cumsum(np.bincount(self.of, weights=mcus, minlength=len(self.first)).astype(np.int64) * 16)])
        return [full[a:b] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())]


def feature(x: np.ndarray) -> str:
    """Size, channel means in hundredths, and a checksum of the tensor."""
    sums = x.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    means = ",".join(str(int(s) * 100 // (x.shape[0] * x.shape[1])) for s in sums)
    return f"{x.shape[0]}x{x.shape[1]}:{means}:{zlib.crc32(np.ascontiguousarray(x)):08x}"


def passed(rows: DataFrame, keep: list[str], value: Column, made: list[K.StructField]) -> tuple[DataFrame, K.StructType]:
    """Kept columns by place and a value, and the schema of the kept columns with what is made of it."""
    names = [f"c{i}" for i in range(len(keep))]
    got = rows.select(*(F.col(files.quoted(c)).alias(n) for c, n in zip(keep, names)), value.alias("v"))
    return got, K.StructType([*(K.StructField(n, got.schema[n].dataType) for n in names), *made])


def to_media(docs: DataFrame, keep: list[str], text_col: str = "text", chunk_bytes: int = 2 << 20) -> DataFrame:
    """`keep` columns and media (binary)."""
    on_workers(docs.sparkSession)
    rows, schema = passed(docs, keep, F.col(files.quoted(text_col)).cast("string"), [K.StructField("media", K.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = files.plain(batch.column(batch.num_columns - 1))
            for a, b in files.slices(np.diff(files.buffers(text)[1]), chunk_bytes):
                media = store(*files.buffers(text.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[:-1]] + [pa.array(media, pa.binary())], names=names)

    return rows.mapInArrow(run, schema).toDF(*keep, "media")


def each_chunk(names: list[str], chunk_bytes: int, columns):
    """Rows whose last column is media, in slices of about `chunk_bytes`: the other columns, and what `columns` makes of the media read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(batch.num_columns - 1)
            sizes = np.array([len(m) for m in media.to_pylist()], np.int64)
            for a, b in files.slices(sizes, chunk_bytes):
                some = media.slice(a, b - a).to_pylist()
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), *columns(some, Read(some))], names=names)

    return run


def to_tensors(media: DataFrame, keep: list[str], media_col: str = "media", chunk_bytes: int = 2 << 20) -> DataFrame:
    """`keep` columns, height, width and rgb (binary, row by row) of each media value: the column of full-resolution tensors."""
    on_workers(media.sparkSession)
    made = [K.StructField("height", K.IntegerType()), K.StructField("width", K.IntegerType()), K.StructField("rgb", K.BinaryType())]
    rows, schema = passed(media.filter(F.col(files.quoted(media_col)).isNotNull()), keep, F.col(files.quoted(media_col)), made)

    def tensors(some: list[bytes], back: Read) -> list[pa.Array]:
        full = back.tensors()
        return [pa.array([x.shape[0] for x in full], pa.int32()), pa.array([x.shape[1] for x in full], pa.int32()), pa.array([x.tobytes() for x in full], pa.binary())]

    return rows.mapInArrow(each_chunk(schema.names, chunk_bytes, tensors), schema).toDF(*keep, "height", "width", "rgb")


def write_media(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The media column as files in the shared folder, read back from them."""
    path = shared_path(docs.sparkSession, "media")
    media = to_media(docs, keep, text_col)
    media.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(media.schema).parquet(path)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(chunk_bytes: int = 2 << 20):
    """(doc_id, media) to its figures, all from the stored bytes."""

    def columns(media: list[bytes], back: Read) -> list[pa.Array]:
        payloads = back.payloads()
        sha = lambda x: hashlib.sha256(x).hexdigest()
        got = [back.n_bytes, [len(p) for p in payloads], map(sha, payloads), [zlib.crc32(p[-64:]) for p in payloads], map(len, media), map(sha, media), map(feature, back.tensors())]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return [pa.array(list(c), k) for c, k in zip(got, kinds)]

    return each_chunk([c.split()[0] for c in DIGEST.split(", ")], chunk_bytes, columns)


def op3_progressive_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return write_media(docs, ["doc_id"]).select("doc_id", "media").mapInArrow(digests(), DIGEST)
