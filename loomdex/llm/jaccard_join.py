"""Exact Jaccard self-join of word-shingle sets, and the classes its links form.

A set links with another when 100 * |intersection| >= 75 * |union|. The plan:

1. One pass over the texts. Each block (an Arrow batch's rows) turns its texts to sorted 64-bit shingle keys, keeps one of
   each group of equal sets, and sends keys, with their sets' places beside them, to buckets by their leading bits, byte-packed.
2. A bucket counts each key. Keys of one set alone can't make a pair; for the others it answers every block with
   (key, frequency, leader), the leader being the smallest set that holds the key. Beyond 2^`one_step_bits` buckets keys and answers go
   in two steps (`Routes`), so that the rows that are shuffled stay large at any size.
3. A block orders each set's keys by (frequency, key). Linked sets share a key among the first n - ceil(0.75 n) + 1, and
   private keys come first, so a set whose private keys fill that prefix links with nothing and is done. Passages that
   many documents share therefore cost nothing. The leaders of the prefix's shared keys are the set's groups: linked
   sets share a prefix key, hence a leader, hence a group.
4. Equal sets of different blocks fall to one. Each group gets its sets' shared keys; groups beyond a bound are cut in parts by a
   hash, and by another hash again, and a part is a task's unit, so memory is bounded and no pair is emitted. The classes found so far
   then spare work: of a large group only the sets outside its main class meet all others, in units of a part of these and a part of
   those. A large group of near copies is one class by then; sets that merely share a passage's key still meet in pairs of parts.
5. Inside a unit, set relations save work at two levels. Sets are numbered by size, and an index list is entered by a
   search for the position where sizes start to fit, past all before (index-level skipping). A set's
   counts are derived from those of its most similar answered set by walking only the lists of keys in which
   the two differ (answer-level skipping). A set that already belongs to the unit's main class needs no answer: its
   links outside are found from the other side. Only a spanning forest leaves the unit.
6. Classes are the forest's components (alternating large and small stars, each round written to the shared folder).

A key that many sets of one block share is sent once for the block with its count, so a key that a third of all rows hold
is a row a block. Keys have 48 bits: two sets of 500 shingles see a false common key with probability 1e-9.

Cases. Null and empty texts and texts of white space alone have the empty set and link with nothing. A text of
fewer than five words is one shingle. Repeated rows of one doc_id are rows of their own. A null doc_id takes part,
and a class that holds only null ids has a null component_id. Texts are read whole. An empty table gives an
empty result. Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import files
from loomdex.llm.shingles import mixed, shingle_keys
from loomdex.runtime import materialise, on_workers

COLD, HOT, DOCS, LISTS, WIDE = range(5)
SENT = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
ANSWER = pa.schema([("to", pa.int64()), ("part", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays with their lengths, byte planes apart so that sorted high bytes compress."""
    out = [np.int64(len(arrays)).tobytes()]
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() if len(a) else b""
        body = pa.compress(planes, "zstd", asbytes=True)
        flag = len(body) < len(planes)
        body = body if flag else planes
        out += [np.array([len(a), len(planes), len(body), flag], np.int64).tobytes(), a.dtype.str.ljust(4).encode(), body]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    at, out = 8, []
    for _ in range(int(np.frombuffer(data, np.int64, 1)[0])):
        n, whole, size, flag = np.frombuffer(data, np.int64, 4, at).tolist()
        kind = np.dtype(data[at + 32 : at + 36].decode().strip())
        body = data[at + 36 : at + 36 + size]
        at += 36 + size
        planes = pa.decompress(body, whole, "zstd", asbytes=True) if flag else body
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind))
    return out


def bucket_of(keys, bits: int):
    """The leading bits."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(x)))


# ---------------------------------------------------------------- 1: texts to keys
class Routes:
    """How keys get to their bucket and answers back to their block. With few buckets a block sends to each and each answers every block.
    With more, such rows would hold a few keys each, so both ways go in two steps: blocks send to `coarse` leading bits in
    shards of blocks, where a task sorts what it got and sends it on by all bits; buckets answer to groups of blocks in parts, where a
    task sorts by block."""

    def __init__(self, rows: int, rows_per_bucket: int, one_step_bits: int, rows_a_task: int = 10_000, blocks_a_group: int = 1024, rows_a_block: int = 5000):
        self.bits = max(4, (-(-rows // rows_per_bucket) - 1).bit_length())
        self.two = self.bits > one_step_bits
        self.coarse = max(1, min(one_step_bits, self.bits) - 2) if self.two else self.bits
        self.shards = -(-rows // (rows_a_task << self.coarse)) if self.two else 1
        self.group_bits = max(0, (rows // (rows_a_block * blocks_a_group)).bit_length())
        self.parts = -(-rows // (2 * rows_a_task << self.group_bits))

    def group_of(self, blocks: np.ndarray) -> np.ndarray:
        return bucket_of(mixed(blocks.astype(np.uint64)), self.group_bits) if self.group_bits else np.zeros(len(blocks), np.int64)

    def home(self, block: int, bits: int) -> int:
        """The bucket that a block's own rows go by."""
        return int(bucket_of(mixed(np.array([block], np.uint64)), bits)[0])

    def to(self, block: int, bucket: int) -> tuple[int, int]:
        return (int(self.group_of(np.array([block]))[0]), bucket % self.parts) if self.two else (block, 0)


def send_keys(routes: Routes, hot: int, block_bytes: int, slice_bytes: int):
    bits = routes.coarse

    def block_rows(batch: pa.RecordBatch, text: pa.Array, block: int) -> list[tuple]:
        rows = len(text)
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint16))]
        for a, b in files.slices(np.diff(files.buffers(text)[1]), slice_bytes):
            keys, owner = shingle_keys(*files.buffers(text.slice(a, b - a)))
            order = np.argsort(keys, kind="stable")  # owners rise already: by key, then owner
            keys, owner = keys[order], (owner[order] + a).astype(np.uint16)
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            parts.append((keys[new], owner[new]))
        keys, owner = map(np.concatenate, zip(*parts))
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        n = np.bincount(owner, minlength=rows)
        by_doc = keys[np.argsort(owner, kind="stable")]
        full = np.flatnonzero(n)
        at = (np.cumsum(n) - n)[full]
        sigs = np.zeros((2, rows), np.uint64)
        for i, salt in enumerate((0x1234567, 0x7654321)):
            if len(full):
                sigs[i, full] = np.add.reduceat(mixed(by_doc + np.uint64(salt)), at)
        order = np.lexsort((np.arange(rows), sigs[1], sigs[0], n))
        new = np.ones(rows, bool)
        new[1:] = (np.diff(n[order]) != 0) | (np.diff(sigs[0][order]) != 0) | (np.diff(sigs[1][order]) != 0)
        first = np.zeros(rows, bool)
        first[order[new]] = True
        kept = first[owner]
        keys, owner = keys[kept], owner[kept]
        starts, lengths = runs(keys)
        many = lengths >= hot
        whole = np.repeat(many, lengths)
        passed = [x for c in batch.columns[:-1] for x in (np.asarray(c.fill_null(0)), np.asarray(c.is_valid()).astype(np.uint8))]
        home, shard = routes.home(block, bits), block % routes.shards
        out = [(home, shard, block, DOCS, packed(n.astype(np.uint32), sigs[0].view(np.int64), sigs[1].view(np.int64), *passed))]
        if many.any():
            out.append((home, shard, block, LISTS, packed(keys[whole], owner[whole])))
        for kind, columns in ((COLD, (keys[~whole], owner[~whole])), (HOT, (keys[starts[many]], owner[starts[many]], lengths[many].astype(np.uint32)))):
            at, size = runs(bucket_of(columns[0], bits))
            out += [(int(bucket_of(columns[0][s], bits)), shard, block, kind, packed(*(c[s : s + k] for c in columns))) for s, k in zip(at.tolist(), size.tolist())]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 20
        for batch in batches:
            text = files.plain(batch.column(batch.num_columns - 1))
            for a, b in files.slices(np.diff(files.buffers(text)[1]), block_bytes):
                for c in range(a, b, 1 << 16):
                    size = min(1 << 16, b - c)
                    rows = block_rows(batch.slice(c, size), text.slice(c, size), block)
                    block += 1
                    for r in range(0, len(rows), 512):
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[r : r + 512]), SENT)], schema=SENT)
                    rows = None
        files.give_back()

    return run


def gathered(table: pa.Table) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """What only passes through, as (block, kind, payload), and all keys with their sets and weights."""
    passing, parts = [], [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for block, kind, payload in zip(*(table.column(c).to_pylist() for c in ("block", "kind", "payload"))):
        if kind in (DOCS, LISTS):
            passing.append((block, kind, payload))
            continue
        keys, sets, *weight = unpacked(payload)
        if kind != WIDE:
            sets = sets.astype(np.int64) + (block << 16)
        parts.append((keys, sets, weight[0].astype(np.int64) if weight else np.ones(len(keys), np.int64)))
    return passing, *map(np.concatenate, zip(*parts))


def as_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def send_on(routes: Routes):
    """The second step of a key's way: a coarse bucket's shard, sorted, goes on in a row a bucket."""

    def run(table: pa.Table) -> pa.Table:
        passing, keys, sets, weight = gathered(table)
        out = [(routes.home(block, routes.bits), 0, block, kind, payload) for block, kind, payload in passing]
        order = np.argsort(keys, kind="stable")
        keys, sets, weight = keys[order], sets[order], np.minimum(weight[order], (1 << 32) - 1).astype(np.uint32)
        at, size = runs(bucket_of(keys, routes.bits))
        out += [(int(bucket_of(keys[s], routes.bits)), 0, -1, WIDE, packed(keys[s : s + k], sets[s : s + k], weight[s : s + k])) for s, k in zip(at.tolist(), size.tolist())]
        return as_table(out, SENT)

    return run


# ---------------------------------------------------------------- 2: a bucket's answer
def answer_bucket(routes: Routes):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        passing, token, dk, weight = gathered(table)
        out = [(*routes.to(block, bucket), block, kind, payload) for block, kind, payload in passing]
        if len(token):
            order = np.argsort(token, kind="stable")
            token, dk, weight = token[order], dk[order], weight[order]
            starts, lengths = runs(token)
            count = np.add.reduceat(weight, starts)
            leader = np.minimum.reduceat(dk, starts)
            shared = count >= 2
            on = np.repeat(shared, lengths)
            token, dk = token[on], dk[on]
            count, leader = (np.repeat(x[shared], lengths[shared]) for x in (np.minimum(count, (1 << 32) - 1).astype(np.uint32), leader))
            out += answers(routes, bucket, token, dk, count, leader)
        return as_table(out, ANSWER)

    return run


def answers(routes: Routes, bucket: int, token: np.ndarray, dk: np.ndarray, count: np.ndarray, leader: np.ndarray) -> list[tuple]:
    """A row for each block, or for each group of blocks."""
    if routes.two:
        group = routes.group_of(dk >> 16)
        order = np.argsort(group, kind="stable")
        at, size = runs(group[order])
        return [(int(group[order[s]]), bucket % routes.parts, -1, WIDE, packed(*(x[order[s : s + k]] for x in (token, dk, count, leader)))) for s, k in zip(at.tolist(), size.tolist())]
    return by_block(token, dk, count, leader)


def by_block(token: np.ndarray, dk: np.ndarray, count: np.ndarray, leader: np.ndarray) -> list[tuple]:
    order = np.argsort(dk >> 16, kind="stable")
    token, dk, count, leader = token[order], dk[order], count[order], leader[order]
    at, size = runs(dk >> 16)
    return [(int(dk[s] >> 16), 0, int(dk[s] >> 16), COLD, packed(token[s : s + k], (dk[s : s + k] & 0xFFFF).astype(np.uint16), count[s : s + k], leader[s : s + k])) for s, k in zip(at.tolist(), size.tolist())]


def spread(table: pa.Table) -> pa.Table:
    """The second step of an answer's way: a group's part, sorted, goes on in a row a block."""
    out, parts = [], []
    for block, kind, payload in zip(*(table.column(c).to_pylist() for c in ("block", "kind", "payload"))):
        if kind == WIDE:
            parts.append(unpacked(payload))
        else:
            out.append((block, 0, block, kind, payload))
    if parts:
        out += by_block(*map(np.concatenate, zip(*parts)))
    return as_table(out, ANSWER)


# ---------------------------------------------------------------- 3: a block's prefixes
def settle_block(carried: int):
    def run(table: pa.Table) -> pa.Table:
        docs, parts = None, []
        lists, owners = np.zeros(0, np.uint64), np.zeros(0, np.uint16)
        block = table.column("block")[0].as_py()
        for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist()):
            if kind == DOCS:
                docs = unpacked(payload)
            elif kind == LISTS:
                lists, owners = unpacked(payload)
            else:
                parts.append(unpacked(payload))
        n, sig_a, sig_b, *passed = docs
        n = n.astype(np.int64)
        rows = len(n)
        token, owner, count, leader = (np.concatenate([p[i] for p in parts]) for i in range(4)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if len(lists):  # a key that stands for a whole list of this block's sets
            a, b = np.searchsorted(lists, token), np.searchsorted(lists, token, side="right")
            one = a == b
            spread = np.repeat(np.flatnonzero(~one), (b - a)[~one])
            at = files.gather(a[~one], (b - a)[~one])
            token, owner = np.concatenate([token[one], lists[at]]), np.concatenate([owner[one], owners[at]])
            count, leader = (np.concatenate([x[one], x[spread]]) for x in (count, leader))
        owner = owner.astype(np.int64)
        order = np.lexsort((token, count, owner))
        token, count, leader, owner = token[order], count[order], leader[order], owner[order]
        shared = np.bincount(owner, minlength=rows)
        prefix = n - (3 * n + 3) // 4 + 1
        need = np.where(n > 0, prefix - (n - shared), 0)
        starts = np.cumsum(shared) - shared
        inside = np.arange(len(owner)) - starts[owner] < need[owner]
        pairs = np.unique(np.stack([owner[inside], leader[inside]]), axis=1) if inside.any() else np.zeros((2, 0), np.int64)
        has = np.bincount(pairs[0], minlength=rows)
        at = np.cumsum(has) - has
        leaders = [pairs[1, a : a + k].tolist() if k else None for a, k in zip(at.tolist(), has.tolist())]
        sent = [np.sort(token[s : s + k]).tobytes() if h else None for s, k, h in zip(starts.tolist(), shared.tolist(), has.tolist())]
        got = [pa.array(n), pa.array(np.arange(rows) + (block << 16)), pa.array(sig_a), pa.array(sig_b), pa.array(leaders, pa.list_(pa.int64())), pa.array(sent, pa.binary())]
        got += [pa.array(passed[2 * i], pa.int64(), mask=passed[2 * i + 1] == 0) for i in range(carried)]
        return pa.Table.from_arrays(got, names=["n", "dk", "sig_a", "sig_b", "leaders", "keys", *(f"p{i}" for i in range(carried))])

    return run


# ---------------------------------------------------------------- 5: inside a unit
class Labels:
    """Union-find over few items; labels are smallest members."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> None:
        seen = np.unique(self.of[np.append(others, a)])
        if len(seen) > 1:
            self.of[np.isin(self.of, seen)] = seen[0]


def linked(common: np.ndarray, n: int | np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """100 common >= 75 (n + sizes - common), and something in common."""
    return (175 * common >= 75 * (n + sizes)) & (common > 0)


def unit_forest(dk: np.ndarray, n: np.ndarray, keys: list[np.ndarray], label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among a unit's sets. Sets of one `label` are known to be of one class."""
    k = len(dk)
    label = dk if label is None else label
    if k == 2:
        common = len(np.intersect1d(keys[0], keys[1], assume_unique=True))
        return [(int(dk.max()), int(dk.min()))] if label[0] != label[1] and linked(np.array([common]), int(n[0]), n[1:])[0] else []
    order = np.lexsort((dk, n))
    dk, n, keys, label = dk[order], n[order].astype(np.int64), [keys[i] for i in order], label[order]
    token = np.concatenate(keys)
    owner = np.repeat(np.arange(k), [len(x) for x in keys])
    _, token = np.unique(token, return_inverse=True)
    often = np.bincount(token) > 1
    owner, token = owner[often[token]], token[often[token]]
    own = [np.sort(x) for x in np.split(token, np.cumsum(np.bincount(owner, minlength=k))[:-1])]
    entries = np.sort(token * np.int64(k) + owner)  # each list's sets by size, lists end to end
    low = np.searchsorted(n, -(-3 * n // 4))
    high = np.searchsorted(n, 4 * n // 3, side="right")

    def walk(tokens: np.ndarray, a: int, b: int) -> np.ndarray:
        """How many of the tokens each set numbered a to b - 1 holds; each list is entered at the first fitting position."""
        s, e = np.searchsorted(entries, tokens * k + a), np.searchsorted(entries, tokens * k + b)
        return np.bincount(entries[files.gather(s, e - s)] % k - a, minlength=b - a) if b > a else np.zeros(0, np.int64)

    labels = Labels(k)
    _, labels.of, sizes = np.unique(label, return_inverse=True, return_counts=True)
    main = int(np.flatnonzero(labels.of == sizes.argmax())[-1]) if sizes.max() > 1 else k - 1
    answers: dict[int, np.ndarray] = {}
    best = np.zeros(k, np.int64)
    parent = np.full(k, -1)
    room = 40_000_000 // max(1, k)
    for y in range(k - 1, -1, -1):
        if labels.of[y] == labels.of[main] and (y != main or sizes.max() > 1):
            continue  # of the main class: whoever is outside looks at it
        a, b = int(low[y]), int(high[y])
        x = int(parent[y])
        if x in answers and 2 * best[y] > len(own[y]):
            more, less = np.setdiff1d(own[y], own[x], assume_unique=True), np.setdiff1d(own[x], own[y], assume_unique=True)
            c, d = max(a, int(low[x])), min(b, int(high[x]))
            common = np.zeros(b - a, np.int64)
            common[c - a : d - a] = answers[x][c - low[x] : d - low[x]] + walk(more, c, d) - walk(less, c, d)
            common[: c - a] = walk(own[y], a, c)
            common[d - a :] = walk(own[y], d, b)
        else:
            common = walk(own[y], a, b)
        hits = a + np.flatnonzero(linked(common, int(n[y]), n[a:b]))
        labels.join(y, hits)
        if len(answers) < room:
            answers[y] = common
            better = common > best[a:b]
            best[a:b][better] = common[better]
            parent[a:b][better] = y
    smallest = np.full(k, np.iinfo(np.int64).max)
    np.minimum.at(smallest, labels.of, dk)
    root = smallest[labels.of]
    return [(int(u), int(v)) for u, v in zip(dk, root) if u != v]


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit (leader, i, j)."""
    key, held, out = None, [], []

    def close() -> None:
        if len(held) > 1:
            out.extend(unit_forest(np.array([h[0] for h in held]), np.array([h[1] for h in held]), [np.frombuffer(h[2], np.uint64) for h in held], np.array([h[3] for h in held])))

    for batch in batches:
        for leader, i, j, dk, label, n, keys in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (leader, i, j):
                close()
                key, held = (leader, i, j), []
            held.append((dk, n, keys, label))
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], schema=EDGES)
            out = []
    close()
    yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], schema=EDGES)
    files.give_back()


# ---------------------------------------------------------------- 6: components
def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v): each node of an edge, besides the smallest of its component, with that smallest one."""
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = None
    for _ in range(rounds):
        edges = materialise(edges, "links")
        seen = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return edges
        state = seen
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        edges = small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    raise RuntimeError("components did not settle")


def across(large: DataFrame, roots: DataFrame, forest, fits: Column, part) -> DataFrame:
    """Components once the sets of large groups have met beyond their parts: all but those whose class, so far, is the group's main one
    meet each other and the main ones. Members of the main class need not meet each other, so a group of near copies costs
    no more than its rows."""
    known = large.join(roots.select(F.col("u").alias("dk"), F.col("v").alias("root")), "dk", "left").select("leader", "dk", "w", F.coalesce("root", "dk").alias("label"))
    sizes = known.groupBy("leader", "label").agg(F.count("*").alias("c"))
    main = sizes.groupBy("leader").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    known = materialise(known.join(main, "leader"), "labelled")
    rest, rows = known.filter("label <> main"), known.filter("label = main")
    others = materialise(rest.groupBy("leader").agg(fits.alias("others")), "others")
    if others.isEmpty():
        return roots
    others = others.join(rows.groupBy("leader").agg(fits.alias("rows")), "leader")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = rest.join(others, "leader").withColumn("own", part(F.col("others"), 2))
    pairs = rest.select("*", each("others").alias("o")).select("leader", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "dk", "label")
    out = rest.select("*", each("rows").alias("p")).select("leader", F.col("own").alias("i"), (-1 - F.col("p")).alias("j"), "dk", "label")
    back = rows.join(others, "leader").select("*", each("others").alias("i")).select("leader", "i", (-1 - part(F.col("rows"))).alias("j"), "dk", "label")
    return components(roots.unionByName(forest(pairs.unionByName(out).unionByName(back))))


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; see the module."""
    rows = docs.select(F.col(files.quoted(id_col)).cast("long").alias("doc_id"), F.col(files.quoted(text_col)).cast("string").alias("text"))
    return set_classes(rows, ["doc_id"], **bounds).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def set_classes(rows: DataFrame, passed: list[str], text_col: str = "text", rows_per_bucket: int = 1000, hot: int = 64, block_bytes: int = 8 << 20, slice_bytes: int = 1 << 20, unit_sets: int = 1024, unit_bytes: int = 16 << 20, one_step_bits: int = 12) -> DataFrame:
    """The `passed` columns (whole numbers), n (set size), class (a number of the row's class of links, null without a set) and
    least (the class's smallest value of the first passed column), for every row. Bounds are of memory alone: no pair is lost to them."""
    spark = on_workers(rows.sparkSession)
    rows = rows.select(*(F.col(c).cast("long").alias(f"p{i}") for i, c in enumerate(passed)), F.col(text_col).alias("text"))
    carried = [f"p{i}" for i in range(len(passed))]
    routes = Routes(rows.count(), rows_per_bucket, one_step_bits)
    key_rows, answer_rows = "bucket long, shard long, block long, kind int, payload binary", "to long, part long, block long, kind int, payload binary"
    sent = rows.mapInArrow(send_keys(routes, hot, block_bytes, slice_bytes), key_rows)
    if routes.two:
        sent = sent.groupBy("bucket", "shard").applyInArrow(send_on(routes), key_rows)
    answered = sent.groupBy("bucket").applyInArrow(answer_bucket(routes), answer_rows)
    if routes.two:
        answered = answered.groupBy("to", "part").applyInArrow(spread, answer_rows)
    kinds = "n long, dk long, sig_a long, sig_b long, leaders array<long>, keys binary, " + ", ".join(f"{c} long" for c in carried)
    sets = materialise(answered.groupBy("to").applyInArrow(settle_block(len(passed)), kinds), "sets")

    full = sets.filter("n > 0")
    classes = full.groupBy("sig_a", "sig_b", "n").agg(F.min(F.when(F.col("leaders").isNotNull(), F.col("dk"))).alias("dk"), F.min("p0").alias("least_id"), F.min("dk").alias("any_dk"))
    classes = materialise(classes.select("sig_a", "sig_b", "n", F.coalesce("dk", "any_dk").alias("dk"), "least_id"), "classes")
    found = sets.filter("leaders is not null").select("dk", "leaders", F.octet_length("keys").alias("w")).join(classes.select("dk"), "dk", "left_semi")
    member = found.select("dk", "w", F.explode("leaders").alias("leader"))
    fits = lambda n, size: F.greatest(F.ceil(F.count("*") / n), F.ceil(F.sum("w") / size)).cast("int")
    groups = member.groupBy("leader").agg(F.count("*").alias("k"), fits(unit_sets, unit_bytes).alias("parts")).filter("k > 1").select("leader", "parts")
    member = materialise(member.join(groups, "leader"), "members")
    part = lambda n, salt=0: F.pmod(F.xxhash64("dk", F.lit(salt)), n).cast("int")
    every = F.lit(0).alias("j")

    def forest(dealt: DataFrame) -> DataFrame:
        """The edges that the units find; `dealt` has leader, i, j, dk, label."""
        got = dealt.select("leader", "i", "j", "dk", "label").join(sets.filter("leaders is not null").select("dk", "n", "keys"), "dk").select("leader", "i", "j", "dk", "label", "n", "keys")
        return got.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "dk").mapInArrow(units, "u long, v long")

    large = member.filter("parts > 1")
    whole = member.select("leader", part(F.col("parts")).alias("i"), every, "dk", F.col("dk").alias("label"))
    again = large.select("leader", part(F.col("parts"), 1).alias("i"), F.lit(1).alias("j"), "dk", F.col("dk").alias("label"))
    roots = components(forest(whole.unionByName(again)))
    if not large.isEmpty():
        roots = across(large, roots, forest, fits(unit_sets, unit_bytes), part)

    placed = classes.join(roots.select(F.col("u").alias("dk"), F.col("v").alias("root")), "dk", "left").select("sig_a", "sig_b", "n", "least_id", F.coalesce("root", "dk").alias("root"))
    least = materialise(placed.groupBy("root").agg(F.min("least_id").alias("least")), "least")  # apart, so that a hot root's join can be split
    by_set = placed.join(least, "root").select("sig_a", "sig_b", "n", F.col("root").alias("class"), "least")
    keyed = sets.select(*carried, "n", "sig_a", "sig_b")
    some = keyed.filter("n > 0").join(by_set, ["sig_a", "sig_b", "n"], "left").select(*carried, "n", "class", "least")
    none = keyed.filter("n = 0").select(*carried, "n", F.lit(None).cast("long").alias("class"), F.lit(None).cast("long").alias("least"))
    return some.unionByName(none).select(*(F.col(p).alias(c) for p, c in zip(carried, passed)), "n", "class", "least")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_sql() -> str:
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
k AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS c FROM k a JOIN k b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c WHERE 100 * c >= 75 * (an + bn - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.y) AS component_id FROM s JOIN r ON r.x = s.doc_id GROUP BY ALL"""
