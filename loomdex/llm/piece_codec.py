"""SentencePiece encoding and decoding by one pass over an Aho-Corasick automaton.

The automaton holds all pieces. Reading a character moves to a state; its output link chain lists the pieces
that end there, longest first, and each relaxes the best score at its end from that at its start (strictly better only,
so ties keep the longest piece). A position that no one-character piece covers has the fallback: the character's
UTF-8 bytes as byte pieces, at the lowest score less a penalty. Many strings advance together, a character a step, in numpy.

No piece holds a space after another character, and none holds a line feed, so texts are cut before each run of
spaces and around line feeds without changing the best path, and each different cut of a batch is encoded once.

Scores: "model" are the file's own (right for a unigram file). A merge-ranked file holds ranks, which are no
log-probabilities; "zipf", the default, takes rank r to -log(r + 2.7) less the log of their sum (the rank-frequency law).

Cases. Null text counts as empty; empty text has no ids. A text's own U+2581 signs go by their bytes, so decoding gives each
text back exactly. Repeated rows give equal rows. Very long texts are read whole; strings of over 1000 characters without a cut
are walked one by one, in time in proportion to their length. An empty table gives an empty result. Kept columns are passed on by
place, whatever their names; others are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from loomdex.llm import files
from loomdex.runtime import on_workers

SPACE, OWN = "▁", "\ud800"  # a text's own sign goes as a lone surrogate inside the encoder: no text, being UTF-8, can hold one
PENALTY = 10.0


def marked(text: str) -> str:
    """Spaces as the pieces write them."""
    return text.replace(SPACE, OWN).replace(" ", SPACE)


def spelt(point: int) -> bytes:
    """A character's UTF-8, for the fallback."""
    return (chr(point) if point != ord(OWN) else SPACE).encode("utf-8", "surrogatepass")


class Automaton:
    """Pieces as a trie with failure and output links, in flat arrays."""

    def __init__(self, pieces: list[str], ids: list[int], scores: list[float], byte_ids: list[int]):
        chars = sorted(set("".join(pieces)))
        self.code = {c: i + 1 for i, c in enumerate(chars)}  # 0: in no piece
        self.width = len(chars) + 1
        edges: dict[tuple[int, int], int] = {}
        depth, parent, last, end = [0], [0], [0], [-1]
        for k, piece in enumerate(pieces):
            state = 0
            for c in piece:
                step = (state, self.code[c])
                if step not in edges:
                    edges[step] = len(depth)
                    depth.append(depth[state] + 1)
                    parent.append(state)
                    last.append(step[1])
                    end.append(-1)
                state = edges[step]
            end[state] = k
        n = len(depth)
        fail, link = [0] * n, [0] * n
        for s in sorted(range(1, n), key=depth.__getitem__):
            f = fail[parent[s]]
            while parent[s] and f and (f, last[s]) not in edges:
                f = fail[f]
            fail[s] = edges.get((f, last[s]), 0) if parent[s] else 0
            link[s] = fail[s] if end[fail[s]] >= 0 else link[fail[s]]
        keys = np.array([a * self.width + c for a, c in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(edges.values()), np.int32)[order]
        self.fail, self.link = np.array(fail, np.int32), np.array(link, np.int32)
        self.length = np.array(depth, np.int32)
        self.at_end = np.array([e >= 0 for e in end])
        self.score = np.array([scores[e] if e >= 0 else 0.0 for e in end])
        self.id = np.array([ids[e] if e >= 0 else -1 for e in end], np.int32)
        self.byte_ids = np.array(byte_ids, np.int32)
        self.fallback = min(scores, default=0.0) - PENALTY
        self.first = np.where(self.at_end, np.arange(n), self.link)  # the first state of the output chain
        self._steps = None
        top = max((ord(c) for c in chars), default=0)
        self.lookup = np.zeros(top + 2, np.int32)
        for c, i in self.code.items():
            self.lookup[ord(c)] = i

    def move(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next states; failure links are followed until an edge is found or the root is left."""
        out = np.zeros(len(state), np.int32)
        todo = np.flatnonzero(c)
        state = state[todo].astype(np.int64)
        while len(todo):
            want = state * self.width + c[todo]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            out[todo[hit]] = self.next[at[hit]]
            on = ~hit & (state > 0)
            todo, state = todo[on], self.fail[state[on]].astype(np.int64)
        return out

    def encode(self, strings: list[str], at_once: int = 25_000, long: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each string, laid end to end, and their counts. Strings of more than `long` characters go one by one."""
        order = sorted(range(len(strings)), key=lambda i: -len(strings[i]))
        n_long = next((k for k, i in enumerate(order) if len(strings[i]) <= long), len(order))
        pools = [self.walk(strings[i]) for i in order[:n_long]]
        counts = [np.array([len(p) for p in pools], np.int64)]
        for a in range(n_long, len(order), at_once):
            got, n = self._advance([strings[i] for i in order[a : a + at_once]])
            pools.append(got)
            counts.append(n)
        if not order:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        pool, n = np.concatenate(pools), np.concatenate(counts)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        starts = np.cumsum(n) - n
        return pool[files.gather(starts[back], n[back])], n[back]

    def steps(self) -> tuple:
        """The automaton for one string at a time: edges by state and code (moves found by failure links are added, up to a bound),
        failure and output links, lengths and scores as plain lists."""
        if self._steps is None:
            edges = dict(zip(self.keys.tolist(), self.next.tolist()))
            self._steps = (edges, len(edges) + 50_000, *(x.tolist() for x in (self.fail, self.first, self.link, self.length, self.score)))
        return self._steps

    def walk(self, string: str) -> np.ndarray:
        """Ids of one string: the same path as `_advance`, in time in proportion to its length."""
        edges, room, fail, first, link, length, score = self.steps()
        text = np.frombuffer(string.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.lookup[np.minimum(text, len(self.lookup) - 1)].tolist()
        width, fallback = self.width, self.fallback
        best, by, state = [0.0] * (len(code) + 1), [0] * (len(code) + 1), 0
        for at, c in enumerate(code, 1):
            if c:
                to = edges.get(state * width + c)
                if to is None:
                    s = state
                    while to is None and s:
                        s = fail[s]
                        to = edges.get(s * width + c)
                    to = to or 0
                    if len(edges) < room:
                        edges[state * width + c] = to
                state = to
            else:
                state = 0
            top, how, single, s = -math.inf, 0, False, first[state]
            while s:
                n = length[s]
                value = best[at - n] + score[s]
                if value > top:
                    top, how = value, s
                single = single or n == 1
                s = link[s]
            if not single and best[at - 1] + fallback > top:
                top, how = best[at - 1] + fallback, 0
            best[at], by[at] = top, how
        out, at = [], len(code)
        while at:
            s = by[at]
            if s:
                out.append((int(self.id[s]),))
                at -= length[s]
            else:
                at -= 1
                out.append(tuple(self.byte_ids[b] for b in spelt(int(text[at]))))
        return np.array([i for ids in reversed(out) for i in ids], np.int32)

    def _advance(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Strings come longest first, so those still open are a prefix."""
        size = np.array([len(s) for s in strings], np.int64)
        text = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.lookup[np.minimum(text, len(self.lookup) - 1)]
        begin = np.cumsum(size) - size
        base = begin + np.arange(len(strings))  # a string of n characters has n + 1 positions
        best = np.full(len(text) + len(strings), -np.inf)
        best[base] = 0.0
        by = np.zeros(len(best), np.int32)  # the state whose piece ends here; 0: the fallback
        state = np.zeros(len(strings), np.int32)
        for step in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -step))  # those longer than step
            state[:m] = self.move(state[:m], code[begin[:m] + step])
            here = base[:m] + step + 1
            top, how = np.full(m, -np.inf), np.zeros(m, np.int32)
            chain, who = self.first[state[:m]], np.arange(m)
            single = np.zeros(m, bool)
            while True:
                on = chain > 0
                chain, who = chain[on], who[on]
                if not len(who):
                    break
                value = best[here[who] - self.length[chain]] + self.score[chain]
                better = value > top[who]
                top[who[better]], how[who[better]] = value[better], chain[better]
                single[who] |= self.length[chain] == 1
                chain = self.link[chain]
            value = np.where(single, -np.inf, best[here - 1] + self.fallback)
            better = value > top
            best[here], by[here] = np.where(better, value, top), np.where(better, 0, how)
        # Back from each end, all strings together.
        at, open_ = size.copy(), np.arange(len(strings))
        open_ = open_[size > 0]
        where, what, char = [], [], []
        step = 0
        while len(open_):
            s = by[base[open_] + at[open_]]
            where.append(open_)
            what.append(s)
            char.append(np.where(s == 0, begin[open_] + at[open_] - 1, -1))
            at[open_] -= np.where(s == 0, 1, self.length[s])
            open_ = open_[at[open_] > 0]
            step += 1
        if not where:
            return np.zeros(0, np.int32), np.zeros(len(strings), np.int64)
        turn = np.repeat(np.arange(len(where)), [len(w) for w in where])
        where, what, char = map(np.concatenate, (where, what, char))
        order = np.lexsort((-turn, where))
        where, what, char = where[order], what[order], char[order]
        raw = char >= 0
        points = text[char[raw]]
        sizes = np.ones(len(where), np.int64)
        utf = [spelt(p) for p in points.tolist()]
        sizes[raw] = [len(u) for u in utf]
        ids = np.empty(int(sizes.sum()), np.int32)
        place = np.cumsum(sizes) - sizes
        ids[place[~raw]] = self.id[what[~raw]]
        if utf:
            ids[files.gather(place[raw], sizes[raw])] = self.byte_ids[np.frombuffer(b"".join(utf), np.uint8)]
        return ids, np.bincount(where, weights=sizes, minlength=len(strings)).astype(np.int64)


class Codec:
    """A SentencePiece file's pieces, by this module's encoder and decoder."""

    def __init__(self, path: str, scores: str = "zipf"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.vocab_size())
        self.pieces = [model.id_to_piece(i) for i in every]
        normal = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        byte = {self.pieces[i]: i for i in every if model.is_byte(i)}
        self.byte_ids = [byte[f"<0x{b:02X}>"] for b in range(256)]
        for i in normal:
            if SPACE in self.pieces[i].lstrip(SPACE) or "\n" in self.pieces[i]:
                raise ValueError("a piece goes across a cut")
        raw = [model.get_score(i) for i in normal]
        if scores == "zipf":
            rank = np.empty(len(normal))
            rank[np.argsort([-s for s in raw], kind="stable")] = np.arange(len(normal))
            mass = 1 / (rank + 2.7)
            raw = np.log(mass / mass.sum()).tolist()
        self.automaton = Automaton([self.pieces[i] for i in normal], normal, raw, self.byte_ids)
        spelt = [b""] * len(self.pieces)
        for i in normal:
            spelt[i] = self.pieces[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            spelt[i] = bytes([b])
        self.spelt_length = np.array([len(s) for s in spelt], np.int64)
        self.spelt_start = np.cumsum(self.spelt_length) - self.spelt_length
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts (no nulls), laid end to end, and their counts."""
        if pc.any(pc.match_substring(texts, "\x00")).as_py():
            return self._apart(texts)
        spaced = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(" ", texts, ""))
        cut = pc.replace_substring_regex(spaced, "( +|\n+)", "\x00\\1")
        cut = pc.replace_substring_regex(cut, "(\n+)", "\\1\x00")
        parts = pc.split_pattern(cut, "\x00")
        first, last = parts.offsets[0].as_py(), parts.offsets[-1].as_py()
        coded = parts.values.slice(first, last - first).dictionary_encode()
        pool, counts = self.automaton.encode([marked(s) for s in coded.dictionary.to_pylist()])
        starts = np.cumsum(counts) - counts
        index = np.asarray(coded.indices, np.int64)
        bounds = np.asarray(parts.offsets, np.int64) - first
        ends = np.concatenate([[0], np.cumsum(counts[index])])
        return pool[files.gather(starts[index], counts[index])], ends[bounds[1:]] - ends[bounds[:-1]]

    def _apart(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold the cut's own sign: each as one string."""
        return self.automaton.encode([marked(" " + s) if s else "" for s in texts.to_pylist()])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; the leading space that encoding adds goes."""
        size = self.spelt_length[ids]
        data = self.spelt[files.gather(self.spelt_start[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.concatenate([[0], np.cumsum(counts)])
        return [data[ends[a] + (b > a) : ends[b]] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


@lru_cache(maxsize=2)
def codec(path: str, scores: str = "zipf") -> Codec:
    return Codec(path, scores)


def encode_rows(path: str, scores: str, chunk_bytes: int, with_ids: bool, names: list[str]):
    """(row columns..., text last) to the row columns, n_tokens, a checksum, whether decoding gives the text back, and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, scores)
        for batch in batches:
            *others, text = batch.columns
            text = files.plain(text, pa.string())
            for a, b in files.slices(np.diff(files.buffers(text)[1]), chunk_bytes):
                some = text.slice(a, b - a)
                ids, counts = own.encode(some)
                raw = ids.astype("<u4").tobytes()
                at = np.concatenate([[0], np.cumsum(counts)]).tolist()
                raw_text, same = some.cast(pa.binary()), []
                for c, d in files.slices(counts, 1 << 18):  # decoding holds a few words of memory for each byte
                    back = own.decode(ids[at[c] : at[d]], counts[c:d])
                    same += [x == y for x, y in zip(back, raw_text.slice(c, d - c).to_pylist())]
                out = [c.slice(a, b - a) for c in others] + [pa.array(counts, pa.int64()), pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at[:-1], at[1:])], pa.int64()), pa.array(same)]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=names)
        files.give_back()

    return run


def encode_docs(docs: DataFrame, path: str, keep: list[str], text_col: str = "text", scores: str = "zipf", with_ids: bool = True, chunk_bytes: int = 3 << 20) -> DataFrame:
    """`keep` columns, n_tokens, ids_crc32, lossless (decoding gave the text back), and ids; a map without a shuffle."""
    on_workers(docs.sparkSession)
    held = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(files.quoted(c)).alias(n) for c, n in zip(keep, held)), F.col(files.quoted(text_col)).cast("string").alias("t"))
    got = [K.StructField("n", K.LongType()), K.StructField("crc", K.LongType()), K.StructField("same", K.BooleanType()), *([K.StructField("ids", K.ArrayType(K.IntegerType()))] if with_ids else [])]
    schema = K.StructType([*(K.StructField(n, rows.schema[n].dataType) for n in held), *got])
    return rows.mapInArrow(encode_rows(path, scores, chunk_bytes, with_ids, schema.names), schema).toDF(*keep, "n_tokens", "ids_crc32", "lossless", *(["ids"] if with_ids else []))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("long"))
    return encode_docs(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], with_ids=False)
