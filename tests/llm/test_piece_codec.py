import random

import numpy as np
import pyarrow as pa
import pytest

from loomdex.llm import piece_codec as C

public = pytest.importorskip("public_tokenizers")
PATH = public.path("piece_bpe_32k.model")


def plain_best(codec, text):
    """Viterbi over all substrings, with the same fallback: the best score."""
    a = codec.automaton
    score = {}
    for s in np.flatnonzero(a.at_end):
        score[codec.pieces[a.id[s]]] = a.score[s]
    text = text.replace(C.SPACE, C.OWN)
    text = (C.SPACE + text.replace(" ", C.SPACE)) if text else ""
    best = [0.0]
    for j in range(1, len(text) + 1):
        top = max((best[i] + score[text[i:j]] for i in range(max(0, j - 16), j) if text[i:j] in score), default=-np.inf)
        if text[j - 1] not in score:
            top = max(top, best[j - 1] + a.fallback)
        best.append(top)
    return best[-1]


def score_of(codec, ids):
    a = codec.automaton
    value = {int(a.id[s]): a.score[s] for s in np.flatnonzero(a.at_end)}
    total, run = 0.0, b""
    for i in ids:
        if int(i) in value:
            total += value[int(i)]
        else:
            run += bytes([codec.byte_ids.index(int(i))])
            try:
                run.decode("utf-8", "surrogatepass")
                total, run = total + a.fallback, b""
            except UnicodeDecodeError:
                pass
    return total


def test_best_score_and_round_trip(odd):
    codec = C.codec(PATH)
    rng = random.Random(2)
    texts = [t or "" for t in odd if not t or len(t) < 4000] + ["".join(rng.choice(["the", " ", "  ", "er", "x", "é", "\n", "日", "ing", "▁", "A", "9", "\t", "\U0010fffd"]) for _ in range(30)) for _ in range(60)]
    ids, counts = codec.encode(pa.array(texts))
    at = np.concatenate([[0], np.cumsum(counts)])
    assert codec.decode(ids, counts) == [t.encode() for t in texts]
    for t, a, b in zip(texts, at[:-1], at[1:]):
        assert abs(score_of(codec, ids[a:b]) - plain_best(codec, t)) < 1e-6


def test_long_strings_walk_the_same_path():
    a, rng = C.codec(PATH).automaton, random.Random(6)
    strings = ["".join(rng.choice(["the", "er", "x", "é", "日", "ing", C.SPACE, C.OWN, "A", "\U0010fffd", "9"]) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    (one, n), (other, m) = a.encode(strings, long=0), a.encode(strings, long=10**6)
    assert n.tolist() == m.tolist() and one.tolist() == other.tolist()
    ids, counts = C.codec(PATH).encode(pa.array(["z" * 300_000, "日\U0010fffd▁" * 20_000, " "]))
    assert C.codec(PATH).decode(ids, counts) == [("z" * 300_000).encode(), ("日\U0010fffd▁" * 20_000).encode(), b" "]


def test_equals_library_on_a_unigram_model(tmp_path):
    """The same file with its type set to unigram: the library's own search gives these pieces, or a path that scores less."""
    spm = pytest.importorskip("sentencepiece")
    raw = open(PATH, "rb").read()
    out, at = bytearray(), 0

    def varint(b, i):
        n = shift = 0
        while True:
            n |= (b[i] & 127) << shift
            shift += 7
            i += 1
            if b[i - 1] < 128:
                return n, i

    def encoded(n):
        s = bytearray()
        while n > 127:
            s.append(n & 127 | 128)
            n >>= 7
        return bytes(s + bytes([n]))

    while at < len(raw):
        tag, body = varint(raw, at)
        size, start = varint(raw, body)
        part = raw[start : start + size]
        if tag >> 3 == 2:  # trainer: field 3 is the model's type
            i, kept = 0, bytearray()
            while i < len(part):
                key, j = varint(part, i)
                if key & 7 == 2:
                    n, k = varint(part, j)
                    end = k + n
                elif key & 7 == 5:
                    end = j + 4
                else:
                    _, end = varint(part, j)
                kept += encoded(3 << 3) + encoded(1) if key >> 3 == 3 else part[i:end]
                i = end
            part = bytes(kept)
        out += encoded(tag) + encoded(len(part)) + part
        at = start + size
    path = tmp_path / "u.model"
    path.write_bytes(bytes(out))
    library, codec = spm.SentencePieceProcessor(model_file=str(path)), C.Codec(str(path), "model")
    rng = random.Random(4)
    texts = ["hello world", "the quick brown fox", "a  b", "étude naïve", "x\ny\tz", "日本"] + [" ".join("".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 9))) for _ in range(6)) for _ in range(40)]
    ids, counts = codec.encode(pa.array(texts))
    at = np.concatenate([[0], np.cumsum(counts)])
    score = [library.get_score(i) for i in range(library.vocab_size())]
    same = 0
    for t, a, b in zip(texts, at[:-1], at[1:]):
        mine, theirs = ids[a:b].tolist(), library.encode(t)
        assert mine == theirs or sum(score[i] for i in mine) >= sum(score[i] for i in theirs)
        same += mine == theirs
    assert same >= len(texts) - 3


def test_rows(spark, docs, odd):
    got = {r["doc_id"]: r for r in C.encode_docs(docs(odd), PATH, ["doc_id", "score"], chunk_bytes=500).collect()}
    assert all(got[i]["lossless"] for i in range(len(odd))) and got[0]["n_tokens"] == got[1]["n_tokens"] == 0 and got[8]["ids"] == got[9]["ids"]
    assert C.encode_docs(docs([]), PATH, ["doc_id"]).count() == 0
