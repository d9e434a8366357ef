"""Quality scores: random-indexing word vectors pooled per document, then a two-layer network.

Each feature bucket (of words, word ends, word shapes and repeats, all hashed) has a sparse random index vector. A bucket's
context vector is the sum of the index vectors around it, over the training texts, scaled by log frequency: random
indexing. A document is the mean of its features' context and index vectors, besides a few rates of form. A two-layer
network scores it; a temperature, fitted on training rows that the network didn't see, calibrates its odds, and the shares of
the labels among all training rows correct them for the equal numbers it is fitted on.

Fitting takes at most `fit_rows` labelled rows of the training part (the smallest of a hash of doc_id) with their whole texts,
of any length. Executors read them: each task sends a table of context sums of fixed size (whole numbers, so their order does
not matter), then each text's pooled vector; the driver holds `FIT_TASKS` tables and `fit_rows` vectors, whatever the texts. The
tables that are broadcast have a fixed size (`BUCKETS` x `DIMS` floats). Scoring is one map over whole texts, without a shuffle.
Labels, lang, source and doc_id are never inputs of a score.

Cases. Null and empty texts and texts without words have the features of an empty document and get its score. Equal
texts get equal scores, bit for bit, wherever they stand: sums run over a text's own words from its start, and each row's
arithmetic is apart. Very long texts are read whole, in slices of bounded memory. Without labels of both kinds
every score is the share of label 1 among the training labels, or 0.5 without any. A label repeated for a doc_id counts once (the
smallest), a null one never; of rows that share a labelled doc_id the smallest text is fitted. An empty table gives an empty
result. Columns that are kept may have any name: they are passed on by place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from loomdex.llm import files
from loomdex.llm.shingles import _SPACE, mixed, word_keys
from loomdex.runtime import materialise, on_workers

FIT_TASKS = 8
BUCKETS, DIMS, NONZERO, RATES = 1 << 14, 48, 6, 10
_KIND = np.zeros(256, np.uint8)  # of bytes: 1 small letter, 2 capital, 3 digit, 4 sign, 5 beyond ASCII
_KIND[33:127] = 4
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5


def index_vectors(seed: int = 5) -> np.ndarray:
    """A few ones and minus ones for each bucket."""
    rng = np.random.RandomState(seed)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    at = rng.randint(0, DIMS, (BUCKETS, NONZERO))
    np.add.at(out, (np.arange(BUCKETS)[:, None], at), rng.choice([-1, 1], (BUCKETS, NONZERO)).astype(np.float32))
    return out


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: buckets of words (words, 3: word, ending, shape), words of each text, rates of form."""
    keys, counts = word_keys(data, ends)
    texts = len(counts)
    rates = np.zeros((texts, RATES), np.float32)
    if not len(keys):
        return np.zeros((0, 3), np.int64), counts, rates, keys
    blank = _SPACE[data]
    start = ~blank
    start[1:] &= blank[:-1]
    cut = ends[1:-1][ends[1:-1] < len(data)]
    start[cut] = ~blank[cut]
    starts = np.flatnonzero(start)
    solid = np.concatenate([[0], np.cumsum(~blank)])
    size = solid[np.append(starts[1:], len(data))] - solid[starts]
    stop = starts + size
    kind = _KIND[data]
    tail = [data[np.maximum(stop - i, starts)].astype(np.uint64) for i in (1, 2, 3)]
    ending = mixed(tail[0] | tail[1] << np.uint64(8) | tail[2] << np.uint64(16) | np.uint64(1) << np.uint64(40))
    parts = []
    for k in range(1, 6):
        c = np.concatenate([[0], np.cumsum(kind == k)])
        parts.append(c[stop] - c[starts])
    small, capital, digit, sign, beyond = parts
    text = np.repeat(np.arange(texts), counts)
    again = np.zeros(len(keys), bool)
    again[1:] = (keys[1:] == keys[:-1]) & (text[1:] == text[:-1])
    shape = sum(np.minimum(p, 3).astype(np.uint64) << np.uint64(2 * i) for i, p in enumerate(parts)) | np.minimum(size, 15).astype(np.uint64) << np.uint64(12) | again.astype(np.uint64) << np.uint64(17) | np.uint64(1) << np.uint64(41)
    buckets = np.stack([keys, ending, mixed(shape)], axis=1) & np.uint64(BUCKETS - 1)
    full = np.flatnonzero(counts)
    first = (np.cumsum(counts) - counts)[full]
    mean = lambda x: np.add.reduceat(x.astype(np.float64), first) / counts[full]
    letters = small + capital + beyond
    order = np.lexsort((keys, text))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (text[order][1:] != text[order][:-1])
    different = np.bincount(text[order], weights=new, minlength=texts)[full] / counts[full]
    values = [mean(capital > small), mean(sign) / 4, mean(digit) / 4, mean(sign >= 2), mean(again), different, np.minimum(mean(size) / 12, 2), mean(letters == 0), np.log1p(counts[full]) / 8, mean(sign >= size)]
    rates[full] = np.stack(values, axis=1).astype(np.float32)
    return buckets.astype(np.int64), counts, rates, keys


def add_contexts(total: np.ndarray, buckets: np.ndarray, counts: np.ndarray, index: np.ndarray, reach: int = 2) -> None:
    """Adds, to each bucket's row, the index vectors of the words around it."""
    text = np.repeat(np.arange(len(counts)), counts)
    words = index[buckets[:, 0]].astype(np.int32)
    for step in range(1, reach + 1):
        inside = text[step:] == text[:-step]
        for a, b in ((buckets[step:][inside], words[:-step][inside]), (buckets[:-step][inside], words[step:][inside])):
            for k in range(a.shape[1]):
                order = np.argsort(a[:, k], kind="stable")
                keys = a[order, k]
                if len(keys):
                    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    total[keys[starts]] += np.add.reduceat(b[order], starts, axis=0)


def pooled(buckets: np.ndarray, counts: np.ndarray, rates: np.ndarray, table: np.ndarray, piece: int = 4096, at_once: int = 16_384) -> np.ndarray:
    """Mean vector of each text's features, for each of the three families, with the rates of form. A text is summed in pieces of
    `piece` words from its own start, so its sums do not depend on its neighbours."""
    texts = len(counts)
    width = table.shape[1]
    out = np.zeros((texts, 3 * width), np.float64)
    pieces = -(-counts // piece)
    owner = np.repeat(np.arange(texts), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = (np.cumsum(counts) - counts)[owner] + nth * piece
    ends = np.append(starts[1:], len(buckets))
    for a, b in files.slices(ends - starts, at_once):
        rows = slice(starts[a], ends[b - 1])
        for k in range(3):
            sums = np.add.reduceat(table[buckets[rows, k]], starts[a:b] - starts[a], axis=0)
            np.add.at(out[:, k * width : (k + 1) * width], owner[a:b], sums)
    return np.concatenate([out / np.maximum(counts, 1)[:, None], rates], axis=1).astype(np.float32)


def by_rows(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """x @ weights, each element summed in one order: a row's result is the same in any batch."""
    out = np.zeros((len(x), weights.shape[1]))
    for j in range(weights.shape[0]):
        out += x[:, j, None] * weights[j]
    return out


class Network:
    """Two layers in numpy, trained by Adam on weighted log loss; odds are divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 3):
        rng = np.random.RandomState(seed)
        held = np.arange(len(y)) % 6 == 0
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        p = [rng.randn(x.shape[1], hidden) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.randn(hidden, 1) / np.sqrt(hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        fit = np.flatnonzero(~held)
        for _ in range(epochs):
            order = rng.permutation(fit)
            for a in range(0, len(order), 128):
                rows = order[a : a + 128]
                h = np.tanh(z[rows] @ p[0] + p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[rows, None]) / len(rows)
                back = g @ p[2].T * (1 - h * h)
                grads = [z[rows].T @ back + decay * p[0], back.sum(axis=0), h.T @ g + decay * p[2], g.sum(axis=0)]
                t += 1
                for i, d in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.p = p
        odds, best = self.odds(x[held]), (np.inf, 1.0)
        for temperature in np.exp(np.linspace(np.log(0.5), np.log(8), 60)):
            s = np.clip(odds / temperature, -30, 30)
            loss = np.mean(np.log1p(np.exp(-s)) + (1 - y[held]) * s)
            best = min(best, (float(loss), float(temperature)))
        self.temperature = best[1]

    def odds(self, x: np.ndarray) -> np.ndarray:
        return (by_rows(np.tanh(by_rows((x - self.mean) / self.scale, self.p[0]) + self.p[1]), self.p[2]) + self.p[3])[:, 0]

    def scores(self, x: np.ndarray, shift: float = 0.0) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x) / self.temperature + shift, -30, 30)))


class Model:
    """The table of vectors and the network, or one share for all."""

    def __init__(self, share: float = 0.5, shift: float = 0.0, table: np.ndarray | None = None, network: Network | None = None):
        self.share, self.shift, self.table, self.network = share, shift, table, network

    def scores(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(ends) - 1, self.share)
        buckets, counts, rates, _ = features(data, ends)
        return self.network.scores(pooled(buckets, counts, rates, self.table), self.shift)


def in_training(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def context_sums(slice_bytes: int):
    """A task's sums of index vectors around each bucket, and how often it came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total, often = index_vectors(), np.zeros((BUCKETS, DIMS), np.int32), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            text = files.plain(batch.column(2))
            for a, b in files.slices(np.diff(files.buffers(text)[1]), slice_bytes):
                buckets, counts, _, _ = features(*files.buffers(text.slice(a, b - a)))
                add_contexts(total, buckets, counts, index)
                often += np.bincount(buckets.ravel(), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([often.tobytes()], pa.binary())], names=["total", "often"])
        files.give_back()

    return run


def fit_vectors(table, slice_bytes: int):
    """doc_id, y and the pooled vector of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, out = files.plain(batch.column(2)), []
            for a, b in files.slices(np.diff(files.buffers(text)[1]), slice_bytes):
                out += [x.tobytes() for x in pooled(*features(*files.buffers(text.slice(a, b - a)))[:3], table.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "y", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = 4000, slice_bytes: int = 1 << 19) -> Model:
    """At most `fit_rows` training rows; equal numbers of both labels where there are enough."""
    spark = on_workers(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & in_training(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    n1, n = known.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    share = n1 / n if n else 0.5
    order = (F.xxhash64(F.lit(11), "doc_id"), "doc_id")
    some = known.filter("y = 0").orderBy(*order).limit(fit_rows // 2).unionByName(known.filter("y = 1").orderBy(*order).limit(fit_rows // 2))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    chosen = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))  # fit_rows at most
    rows = materialise(chosen.repartition(FIT_TASKS, "doc_id"), "fit-rows")
    f1, f = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    if f < 20 or f1 in (0, f):
        return Model(share)
    total, often = np.zeros((BUCKETS, DIMS), np.int64), np.zeros(BUCKETS, np.int64)
    for r in rows.coalesce(FIT_TASKS).mapInArrow(context_sums(slice_bytes), "total binary, often binary").collect():  # FIT_TASKS tables at most
        total += np.frombuffer(r["total"], np.int32).reshape(BUCKETS, DIMS)
        often += np.frombuffer(r["often"], np.int64)
    context = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9) * np.log1p(often)[:, None] / 4
    table = np.concatenate([context, index_vectors() / 4], axis=1).astype(np.float32)
    got = rows.mapInArrow(fit_vectors(spark.sparkContext.broadcast(table), slice_bytes), "doc_id long, y int, x binary")
    got = got.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").collect()  # fit_rows vectors of fixed length
    network = Network(np.stack([np.frombuffer(r["x"], np.float32) for r in got]), np.array([r["y"] for r in got], np.float64))
    return Model(share, float(np.log(n1 / (n - n1)) - np.log(f1 / (f - f1))), table, network)


def score_rows(model, names: list[str], slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            text = files.plain(batch.column(batch.num_columns - 1))
            scores = [own.scores(*files.buffers(text.slice(a, b - a))) for a, b in files.slices(np.diff(files.buffers(text)[1]), slice_bytes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=names)
        files.give_back()

    return run


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", out: str = "score", slice_bytes: int = 1 << 19) -> DataFrame:
    """`keep` columns and `out`, the score; a kept column of that name stays beside it."""
    spark = on_workers(docs.sparkSession)
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(files.quoted(c)).alias(n) for c, n in zip(keep, names)), F.col(files.quoted(text_col)).cast("string").alias("t"))
    schema = K.StructType([*(K.StructField(n, rows.schema[n].dataType) for n in names), K.StructField("s", K.DoubleType())])
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x 2 DIMS floats, whatever the corpus
    return rows.mapInArrow(score_rows(shared, [*names, "s"], slice_bytes), schema).toDF(*keep, out)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, ["doc_id"]).select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
