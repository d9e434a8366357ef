"""Token ids as directly addressable codes (DACs).

Ids are split into chunks of `width` bits. Level 0 holds every id's lowest chunk and a bitmap that says
which ids go on; level 1 holds the next chunk of those alone, and so on. A rank directory (ones before
each block of 512 bits) finds an id's chunk in the next level, so any token is read without decoding a block.

Cases. Null text counts as empty: the document is the end id alone. A null doc_id sorts before all others.
Repeated rows and equal ids keep a segment each, in the order of (doc_id, n_tokens, ids). Very long
texts only lengthen their segment. An empty table gives no files and an empty result. Columns beyond the two
that are named are not read, so clashing names do not matter.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.llm import files
from loomdex.runtime import materialise, on_workers, shared_path

MAGIC = b"DACF0001"
BLOCK = 512
MARK = "\x01"


# ---------------------------------------------------------------- the codes
def pack(ids: np.ndarray, width: int = 8) -> list[dict]:
    """Levels of chunks: dtype by width, continuation bitmap (absent on the last level) and rank directory."""
    rest, levels = ids.astype(np.uint32), []
    dtype = np.uint8 if width <= 8 else np.uint16
    while True:
        more = rest >> np.uint32(width)
        level = {"n": len(rest), "chunks": (rest & np.uint32((1 << width) - 1)).astype(dtype)}
        levels.append(level)
        on = more > 0
        if not on.any():
            return levels
        level["bits"] = np.packbits(on, bitorder="little")
        ones = np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype=np.int64)
        level["rank"] = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32 if len(on) < 1 << 32 else np.uint64)
        rest = more[on]


def unpack(levels: list[dict], width: int = 8) -> np.ndarray:
    """All ids, from the last level up."""
    above = None
    for level in reversed(levels):
        got = level["chunks"].astype(np.uint32)
        if above is not None:
            on = np.unpackbits(level["bits"], count=level["n"], bitorder="little").view(bool)
            got[on] |= above << np.uint32(width)
        above = got
    return above


def access(levels: list[dict], at: int, width: int = 8) -> int:
    """One id by its position: one chunk and one rank query a level."""
    value = shift = 0
    for level in levels:
        value |= int(level["chunks"][at]) << shift
        if "bits" not in level or not level["bits"][at >> 3] >> (at & 7) & 1:
            return value
        block = at // BLOCK
        first = block * BLOCK >> 3
        whole = level["bits"][first : at >> 3]
        part = int(level["bits"][at >> 3]) & ((1 << (at & 7)) - 1)
        at = int(level["rank"][block]) + int(np.unpackbits(whole).sum()) + part.bit_count()
        shift += width
    return value


def dump(doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray, width: int = 8) -> bytes:
    """A file: magic, a JSON header with the place of each part, then the parts."""
    parts: list[np.ndarray] = [doc_ids.astype("<i8"), known.astype(np.uint8), counts.astype("<i8")]
    levels = pack(ids, width)
    for level in levels:
        parts += [level[k] for k in ("chunks", "bits", "rank") if k in level]
    head = {"docs": len(doc_ids), "width": width, "levels": [{"n": x["n"], "more": "bits" in x} for x in levels], "parts": [[p.dtype.str, len(p)] for p in parts]}
    text = json.dumps(head).encode()
    return b"".join([MAGIC, struct.pack("<I", len(text)), text, *(p.tobytes() for p in parts)])


class DacFile:
    """A file's bytes, read in place."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token code file")
        (n,) = struct.unpack_from("<I", data, 8)
        head, at, parts = json.loads(data[12 : 12 + n]), 12 + n, []
        for kind, count in head["parts"]:
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        self.width, self.doc_ids, self.known, self.counts = head["width"], parts[0], parts[1].astype(bool), parts[2]
        self.starts = np.cumsum(self.counts) - self.counts
        rest, self.levels = iter(parts[3:]), []
        for x in head["levels"]:
            level = {"n": x["n"], "chunks": next(rest)}
            if x["more"]:
                level |= {"bits": next(rest), "rank": next(rest)}
            self.levels.append(level)

    def token(self, at: int) -> int:
        return access(self.levels, at, self.width)

    def ids(self) -> np.ndarray:
        return unpack(self.levels, self.width)


# ---------------------------------------------------------------- encoding
@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Kinds of printable ASCII for the splitter: 1 letter, 2 digit, 3 any other sign; 0 for an apostrophe (it may begin a piece with letters
#: after it), for control signs and for bytes beyond ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[0x27] = 0


def piece_counts(words: list[str]) -> np.ndarray:
    """How many pieces the splitter cuts each word into: a run of letters is one, a digit is one, a run of other signs is one. 0 where a
    word is empty, holds a byte of kind 0, or might hold an added token."""
    raw = [w.encode() for w in words]
    size = np.array([len(r) for r in raw], np.int64)
    kind = _KIND[np.frombuffer(b"".join(raw), np.uint8)]
    full = np.flatnonzero(size)
    starts = (np.cumsum(size) - size)[full]
    count = np.zeros(len(words), np.int64)
    if len(full):
        new = kind == 2
        new[1:] |= kind[1:] != kind[:-1]
        new[starts] = True
        count[full] = np.where(np.minimum.reduceat(kind, starts) == 0, 0, np.add.reduceat(new, starts, dtype=np.int64))
    count[[i for i, r in enumerate(raw) if b"<|" in r]] = 0
    return count


class Encoder:
    """Ids of words (without white space), many to a call. Where pieces end in a suffix, a printable ASCII word's ids end at
    its last piece's end, by the known number of its pieces. Other words stand between marks; where that isn't clear, each is encoded alone."""

    def __init__(self, tok, suffix: str | None, at_once: int = 500):
        self.tok, self.at_once = tok, at_once
        mark = tok.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.closes = np.zeros(tok.get_vocab_size() if suffix else 0, bool)
        if suffix:
            self.closes[[i for t, i in tok.get_vocab().items() if t.endswith(suffix)]] = True

    def alone(self, words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        each = [np.array(x.ids, np.uint32) for x in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        return each, np.array([len(x) for x in each], np.int64)

    def groups(self, words: list[str], by: str, cut) -> tuple[np.ndarray, np.ndarray]:
        """Words joined by `by`; `cut(ids, first, last)` gives the ids and the counts of words first to last - 1, or None."""
        flat, counts = [], []
        bounds = [(a, min(a + self.at_once, len(words))) for a in range(0, len(words), self.at_once)]
        got = self.tok.encode_batch_fast([by.join(words[a:b]) for a, b in bounds], add_special_tokens=False)
        for (a, b), x in zip(bounds, got):
            ids = np.array(x.ids, np.uint32)
            ids, n = cut(ids, a, b) or self.alone(words[a:b])
            flat += ids if isinstance(ids, list) else [ids]
            counts.append(n)
        return (np.concatenate(flat), np.concatenate(counts)) if counts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, laid end to end, and their counts."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        pieces = piece_counts(words) if len(self.closes) else np.zeros(len(words), np.int64)
        plain = np.flatnonzero(pieces)
        upto = np.concatenate([[0], np.cumsum(pieces[plain])])

        def by_ends(ids: np.ndarray, a: int, b: int):
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != upto[b] - upto[a]:
                return None
            return ids, np.diff(np.concatenate([[0], ends[upto[a + 1 : b + 1] - upto[a] - 1]]))

        def by_marks(ids: np.ndarray, a: int, b: int):
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) != b - a - 1:  # a word gave the mark's id itself
                return None
            return np.delete(ids, cut), np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1

        odd = np.flatnonzero(pieces == 0)
        marked = [i for i in odd.tolist() if MARK not in words[i]] if self.mark is not None else []
        alone = np.setdiff1d(odd, marked)
        apart, n_apart = self.alone([words[i] for i in alone.tolist()]) if len(alone) else ([], np.zeros(0, np.int64))
        parts = [self.groups([words[i] for i in plain.tolist()], " ", by_ends), self.groups([words[i] for i in marked], f" {MARK} ", by_marks), (np.concatenate(apart) if apart else np.zeros(0, np.uint32), n_apart)]
        pool = np.concatenate([p for p, _ in parts])
        at, counts = np.concatenate([plain, np.array(marked, np.int64), alone]), np.zeros(len(words), np.int64)
        n = np.concatenate([c for _, c in parts])
        counts[at] = n
        starts = np.zeros(len(words), np.int64)
        starts[at] = np.cumsum(n) - n
        return pool[files.gather(starts, counts)], counts


#: Split patterns none of whose matches holds or looks at white space. Fixed values, as tokenizer files write them.
WORD_PATTERNS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
#: Normalisers that work on each side of white space alone: it takes part in no canonical composition or reordering, and case is mapped
#: code point by code point.
LOCAL = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})


@lru_cache(maxsize=2)
def words_apart(path: str) -> bool:
    """Whether a text's ids are those of its words, laid end to end: the file's normalisers are local, its first splitter keeps only
    matches that hold no white space, its model is plain BPE, and no added token touches white space. Any other file's texts are
    encoded whole."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = lambda x, key: [] if x is None else x[key] if x["type"] == "Sequence" else [x]
    split = (steps(spec["pre_tokenizer"], "pretokenizers") or [{}])[0]
    return (
        all(n in LOCAL for n in steps(spec["normalizer"], "normalizers"))
        and split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and split["pattern"].get("Regex") in WORD_PATTERNS
        and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
        and not spec["truncation"] and not spec["padding"] and spec["post_processor"] is None
        and all(t["content"] and not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    )


class Words:
    """Ids of words, kept over a worker's batches up to a bound; the rest are encoded again when they come again."""

    def __init__(self, tok, apart: bool, most: int = 400_000):
        self.tok, self.apart, self.most = tok, apart, most
        self.encode = Encoder(tok, getattr(tok.model, "end_of_word_suffix", None)) if apart else None
        self.place: dict[str, int] = {}
        self.pool, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and each word's start and count in it."""
        get = self.place.get
        at = np.array([get(w, -1) for w in words], np.int64)
        missing = np.flatnonzero(at < 0)
        new = [words[i] for i in missing.tolist()]
        pool, counts = self.encode(new)
        at[missing] = len(self.starts) + np.arange(len(new))
        starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(counts) - counts])
        pool, counts = np.concatenate([self.pool, pool]), np.concatenate([self.counts, counts])
        room = self.most - len(self.place)
        if room > 0:
            kept = new[:room]
            self.place.update(zip(kept, range(len(self.starts), len(self.starts) + len(kept))))
            n = len(self.starts) + len(kept)
            self.starts, self.counts = starts[:n].copy(), counts[:n].copy()
            self.pool = pool[: int(starts[n - 1] + counts[n - 1]) if n else 0].copy()
        return pool, starts[at], counts[at]


@lru_cache(maxsize=2)
def worker_words(path: str) -> Words:
    return Words(tokenizer(path), words_apart(path))


def encode_whole(tok, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts, laid end to end, and each text's count."""
    end = [] if end_id is None else [end_id]
    each = [np.array([*x.ids, *end], np.uint32) for x in tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
    return np.concatenate(each) if each else np.zeros(0, np.uint32), np.array([len(x) for x in each], np.int64)


def encode_texts(known: Words, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The same ids as `encode_whole`; where words are encoded apart by the file's own rules, each different word once."""
    if not known.apart:
        return encode_whole(known.tok, texts, end_id)
    words = pc.ascii_split_whitespace(texts)
    first, last = words.offsets[0].as_py(), words.offsets[-1].as_py()
    coded = words.values.slice(first, last - first).dictionary_encode()
    pool, starts, counts = known.ids(coded.dictionary.to_pylist())
    index = np.asarray(coded.indices, dtype=np.int64)
    starts, lengths = starts[index], counts[index]
    bounds = np.asarray(words.offsets, dtype=np.int64) - first
    if end_id is not None:  # an end after each text
        pool = np.append(pool, np.uint32(end_id))
        starts = np.insert(starts, bounds[1:], len(pool) - 1)
        lengths = np.insert(lengths, bounds[1:], 1)
        bounds = bounds + np.arange(len(bounds))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return pool[files.gather(starts, lengths)], ends[bounds[1:]] - ends[bounds[:-1]]


ENCODED = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def encoder(path: str, end_id: int | None, cuts: list[int], chunk_bytes: int):
    cut = np.array(cuts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, known = tokenizer(path), worker_words(path)
        small = np.uint16 if tok.get_vocab_size() <= 1 << 16 else np.uint32
        for batch in batches:
            text = files.plain(batch.column(1), pa.string())
            for a, b in files.slices(np.diff(files.buffers(text)[1]), chunk_bytes):
                ids, counts = encode_texts(known, text.slice(a, b - a), end_id)
                doc = batch.column(0).slice(a, b - a)
                shard = np.searchsorted(cut, np.asarray(doc.fill_null(-(1 << 63))), side="right").astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(counts)])
                raw, size = ids.astype(small).tobytes(), np.dtype(small).itemsize
                yield pa.RecordBatch.from_arrays([pa.array(shard), doc.cast(pa.int64()), pa.array(counts, pa.int64()), pa.array([raw[s * size : e * size] for s, e in zip(ends[:-1], ends[1:])], pa.binary())], schema=ENCODED)

    return run


MANIFEST = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def writer(folder: str, width: int, item: int, file_tokens: int):
    """One task holds whole shards in order; a file ends at its shard's end or at `file_tokens`."""
    small = np.uint16 if item == 2 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, docs, counts, blobs, total = None, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            name = f"tokens-{shard:08d}-{part:05d}.dac"
            known = np.array([d is not None for d in docs])
            data = dump(np.array([d or 0 for d in docs], np.int64), known, np.array(counts, np.int64), np.frombuffer(b"".join(blobs), small), width)
            files.put(folder, name, data)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, part, name, len(docs), total), MANIFEST)], schema=MANIFEST)

        for batch in batches:
            for s, d, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if docs and (s != shard or total + n > file_tokens):
                    yield close()
                    part, docs, counts, blobs, total = (part + 1 if s == shard else 0), [], [], [], 0
                shard = s
                docs.append(d)
                counts.append(n)
                blobs.append(ids)
                total += n
        if docs:
            yield close()

    return run


def write_codes(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, width: int = 8, docs_per_shard: int = 4096, file_tokens: int = 1 << 21, chunk_bytes: int = 6 << 20) -> tuple[str, DataFrame]:
    """Write the ids of all texts in ascending id order; returns the folder and its manifest (shard, part, name, n_docs, n_tokens).

    The id range is cut at quantiles (read from the id column alone, `docs_per_shard` rows a shard), so the one
    shuffle moves encoded ids and each shard's rows meet in one task, sorted. Memory is bounded by `file_tokens`."""
    spark = on_workers(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = rows.count()
    shards = max(1, -(-n // docs_per_shard))
    cuts = sorted(set(map(int, rows.approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.1 / shards)))) if shards > 1 else []
    run = encoder(tokenizer_path, end_id, cuts, chunk_bytes)
    coded = rows.mapInArrow(run, "shard int, doc_id long, n_tokens long, ids binary")
    folder = shared_path(spark, "token-codes")
    item = 2 if tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else 4
    dealt = coded.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", "doc_id", "n_tokens", "ids")
    manifest = dealt.mapInArrow(writer(folder, width, item, file_tokens), "shard int, part int, name string, n_docs long, n_tokens long")
    return folder, materialise(manifest, "token-manifest")


DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("last_token", pa.int64())])


def reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = DacFile(files.get(folder, name))
                raw = got.ids().astype("<u4").tobytes()
                ends = (got.starts + got.counts).tolist()
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(got.starts.tolist(), ends)]
                last = [got.token(e - 1) if e > s else None for s, e in zip(got.starts.tolist(), ends)]
                yield pa.RecordBatch.from_arrays([pa.array(got.doc_ids, pa.int64(), mask=~got.known), pa.array(got.starts + start), pa.array(got.counts.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(last, pa.int64())], schema=DIGEST)

    return run


def read_digests(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: place of its first id among all ids, count, checksum, and its last id by random access."""
    order = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = manifest.select("name", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("start"))
    n_files = max(1, manifest.count())
    return placed.repartition(n_files, "name").mapInArrow(reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long, last_token long")


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder, manifest = write_codes(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return read_digests(spark, folder, manifest)
