"""Vector functions: native expressions where they exist, numpy in Arrow batches for rotations and packed codes."""

from __future__ import annotations

import json
import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- native -------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def truncated(a: Column, dims: int) -> Column:
    """The first dimensions at unit length; the vector itself where it has no more."""
    return F.when(F.size(a) <= dims, F.transform(a, lambda x: x.cast("double"))).otherwise(unit(F.slice(a, 1, dims)))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def sign_code(a: Column) -> Column:
    """A bit for each component above 0, in words of 32 bits held as longs."""
    words = F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / 32).cast("int")), lambda w: F.slice(a, w * 32 + 1, F.lit(32)))
    return F.transform(words, lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s * 2 + (x > 0).cast("long")))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def packed_size(dims: int, bits: int) -> int:
    return -(-dims * bits // 8)


# ---- rotation and codebook ----------------------------------------------------------------------


def walsh(x: np.ndarray) -> np.ndarray:
    """The transform of rows whose length is a power of two, at unit scale."""
    n = x.shape[-1]
    y, h = x.reshape(-1, n), 1
    while h < n:
        y = y.reshape(-1, n // (2 * h), 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(-1, n)
        h *= 2
    return (y / math.sqrt(n)).reshape(x.shape)


def blocks(dims: int) -> list[int]:
    """Powers of two that add up to the dimensions, largest first."""
    return [1 << i for i in range(dims.bit_length() - 1, -1, -1) if dims >> i & 1]


class Rotation:
    """Seeded signs, then the transform of each block; its inverse undoes both."""

    def __init__(self, dims: int, seed: int = 42):
        self.sizes = blocks(dims)
        self.signs = np.random.RandomState(seed).choice([-1.0, 1.0], dims)

    def _each(self, x: np.ndarray) -> np.ndarray:
        out, at = np.empty_like(x), 0
        for n in self.sizes:
            out[..., at : at + n] = walsh(x[..., at : at + n])
            at += n
        return out

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._each(x * self.signs)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._each(x) * self.signs


def _pdf(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi) if abs(x) != math.inf else 0.0


def _cdf(x: float) -> float:
    return (1 + math.erf(x / math.sqrt(2))) / 2


@lru_cache(maxsize=16)
def centroids(dims: int, bits: int, rounds: int = 100, tolerance: float = 1e-10) -> tuple[float, ...]:
    """Lloyd-Max levels of the standard normal law, for components of a unit vector."""
    n = 1 << bits
    level = [-3 + 6 * (i + 0.5) / n for i in range(n)]
    for _ in range(rounds):
        edge = [-math.inf, *((a + b) / 2 for a, b in zip(level, level[1:])), math.inf]
        new = []
        for a, b, old in zip(edge, edge[1:], level):
            mass = _cdf(b) - _cdf(a)
            new.append((_pdf(a) - _pdf(b)) / mass if mass > 1e-15 else old)
        moved = max(abs(a - b) for a, b in zip(level, new))
        level = new
        if moved < tolerance:
            break
    return tuple(x / math.sqrt(dims) for x in level)


def pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of small integers to bytes, high bits first."""
    planes = (codes[..., None] >> np.arange(bits - 1, -1, -1)) & 1
    return np.packbits(planes.reshape(len(codes), -1).astype(np.uint8), axis=1)


def unpack(data: np.ndarray, dims: int, bits: int) -> np.ndarray:
    planes = np.unpackbits(data, axis=1)[:, : dims * bits].reshape(len(data), dims, bits)
    return planes @ (1 << np.arange(bits - 1, -1, -1))


class Quantizer:
    """Rotate, take the nearest level, pack; and back."""

    def __init__(self, dims: int, bits: int = 4, seed: int = 42):
        self.dims, self.bits, self.rotation = dims, bits, Rotation(dims, seed)
        self.levels = np.array(centroids(dims, bits))
        self.edges = (self.levels[1:] + self.levels[:-1]) / 2

    def encode(self, x: np.ndarray) -> np.ndarray:
        return pack(np.searchsorted(self.edges, self.rotation.forward(x)), self.bits)

    def rotated(self, data: np.ndarray) -> np.ndarray:
        return self.levels[unpack(data, self.dims, self.bits)]

    def decode(self, data: np.ndarray) -> np.ndarray:
        return self.rotation.inverse(self.rotated(data))

    def dots(self, query: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Approximate inner products in the rotated space: the query is rotated once."""
        return self.rotated(data) @ self.rotation.forward(query)


def _rows(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in s]) if len(s) else np.zeros((0, 1))


def quantize(a: Column, dims: int, bits: int = 4, seed: int = 42) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([r.tobytes() for r in Quantizer(dims, bits, seed).encode(_rows(s))], dtype=object)

    return run(a)


def dequantize(code: Column, dims: int, bits: int = 4, seed: int = 42) -> Column:
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        data = np.stack([np.frombuffer(x, np.uint8) for x in s]) if len(s) else np.zeros((0, packed_size(dims, bits)), np.uint8)
        return pd.Series(list(Quantizer(dims, bits, seed).decode(data)), dtype=object)

    return run(code)


def any_encoding(blob: Column, dims: int, bits: int = 4, seed: int = 42) -> Column:
    """Unit vectors from stored bytes: float32 or packed codes, told apart by their exact length, or JSON numbers; null for anything else."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        q, out = Quantizer(dims, bits, seed), []
        for x in s:
            v = None
            if x is not None and len(x) == 4 * dims:
                v = np.frombuffer(x, "<f4").astype(np.float64)
            elif x is not None and len(x) == packed_size(dims, bits):
                v = q.decode(np.frombuffer(x, np.uint8)[None])[0]
            elif x is not None and x[:1] == b"[":
                try:
                    v = np.array(json.loads(x), np.float64)
                except (ValueError, TypeError):
                    v = None
            size = np.linalg.norm(v) if v is not None and v.shape == (dims,) and np.isfinite(v).all() else 0
            out.append((v / size).tolist() if size > 0 else None)
        return pd.Series(out, dtype=object)

    return run(blob)


def code_dot(code: Column, query: list[float], bits: int = 4, seed: int = 42) -> Column:
    dims = len(query)

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        data = np.stack([np.frombuffer(x, np.uint8) for x in s]) if len(s) else np.zeros((0, packed_size(dims, bits)), np.uint8)
        return pd.Series(Quantizer(dims, bits, seed).dots(np.array(query), data))

    return run(code)


def hashed_embedding(tokens: Column, dims: int = 64) -> Column:
    """The default embedder: signed counts of hashed tokens at unit length; never zero for a text with tokens unless they cancel."""
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int")
    sign = lambda t: F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    pairs = F.transform(tokens, lambda t: F.struct(place(t).alias("p"), sign(t).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(F.filter(pairs, lambda x: x["p"] == d), F.lit(0.0), lambda a, x: a + x["s"]))
    return unit(raw)
