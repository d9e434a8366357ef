import hashlib
import zlib

import numpy as np
import pytest

from loomdex.llm import media as M
from loomdex.llm import progressive as P

S420, S444, S422 = ((2, 2), (1, 1), (1, 1)), ((1, 1), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1))
KINDS = {
    "dense": lambda r, n: r.randint(-128, 130, (n, 64)),
    "sparse": lambda r, n: r.randint(-3, 4, (n, 64)) * (r.rand(n, 64) < 0.1),
    "ones": lambda r, n: r.randint(-2, 3, (n, 64)),
    "zero": lambda r, n: np.zeros((n, 64)),
    "large": lambda r, n: r.randint(-1000, 1000, (n, 64)) * (r.rand(n, 64) < 0.5),
    "few": lambda r, n: r.randint(-2, 3, (n, 64)) * (r.rand(n, 64) < 0.02),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("sampling", [S420, S444, S422])
def test_codec_is_lossless(kind, sampling):
    shapes = [P.layout(w, h, sampling) for w, h in ((16, 16), (37, 50), (8, 100), (64, 64))]
    coefs = KINDS[kind](np.random.RandomState(7), sum(x.blocks for x in shapes)).astype(np.int16)
    for interval in (1, 3, 8):
        got, images = P.decode(P.encode(coefs, shapes, [b"n"] * 4, interval))
        at = 0
        for x, image in zip(shapes, images):
            assert image.comment == b"n" and (image.layout.width, image.layout.height) == (x.width, x.height)
            for c, (rows, cols) in enumerate(x.grids):
                a, b = (v[at + x.first[c] : at + x.first[c + 1]].reshape(rows, cols, 64)[: x.real[c][0], : x.real[c][1]] for v in (coefs, got))
                assert (a == b).all()
            at += x.blocks


def test_inverse_transform():
    coefs = np.zeros((1, 64))
    coefs[0, 0] = 80
    assert (P.samples(coefs, np.ones(64)) == 138).all()
    k = np.arange(8)
    basis = np.cos((2 * k + 1) * np.pi / 16) * 0.5 * np.sqrt(0.125)
    coefs = np.zeros((1, 64))
    coefs[0, 1] = 100
    assert np.abs(P.samples(coefs, np.ones(64))[0, 3] - (128 + 100 * basis)).max() <= 0.51
    assert sorted(P.zigzag()) == list(range(64)) and P.zigzag()[:6].tolist() == [0, 1, 8, 16, 9, 2]
    assert P.rgb(np.array([76]), np.array([85]), np.array([255])).tolist() == [[254, 0, 0]]


def payload(t):
    b = (t or "").encode()
    return b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")


def slow_feature(media):
    """The feature by the textbook: each block's inverse transform as a sum of cosines, chroma repeated, RGB by the JFIF formula, in
    whole numbers as the codec rounds them; here from the general path, an image at a time."""
    read = M.Read([media])
    full = np.concatenate([P.tensor(read.coefs[b : b + x.layout.blocks], x) for b, x in zip(read.base, read.images)])
    means = [int(full[:, :, c].astype(np.int64).sum()) * 100 // (full.shape[0] * full.shape[1]) for c in range(3)]
    return f"{full.shape[0]}x{full.shape[1]}:{','.join(map(str, means))}:{zlib.crc32(full.tobytes()):08x}"


def test_query(spark, docs, odd, tmp_path):
    texts = [*odd, "\x7f\x81あいう" * 100]
    ids = [None, *range(1, len(texts))]
    docs(texts, ids).repartition(2).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in M.op3_progressive_media(spark, f"file://{tmp_path}").collect()}
    assert len(got) == len(texts) and list(got[1].asDict())[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    stored = {r["doc_id"]: r["media"] for r in M.to_media(docs(texts, ids), ["doc_id"]).collect()}
    for i, t in zip(ids, texts):
        p, r = payload(t), got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len((t or "").encode()), len(p), zlib.crc32(p[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["media_sha256"] == hashlib.sha256(stored[i]).hexdigest()
        assert r["media_bytes"] == len(stored[i]) and r["feature"] == slow_feature(stored[i])
    assert got[8][1:] == got[9][1:] and got[None][1:] == got[1][1:]
    docs([]).write.parquet(f"file://{tmp_path}/none/documents.parquet")
    assert M.op3_progressive_media(spark, f"file://{tmp_path}/none").count() == 0


def test_columns_of_any_name(spark, docs):
    d = docs(["x" * 500]).withColumnsRenamed({"score": "v", "lang": "media", "source": "c0"})
    media = M.to_media(d, ["doc_id", "v", "c0", "media"]).toDF("doc_id", "v", "c0", "rgb", "bytes")
    got = M.to_tensors(media, ["v", "rgb"], "bytes").collect()
    assert got[0][0] == "clash" and got[0][1] == "en" and len(got[0][4]) == got[0][2] * got[0][3] * 3


def test_tensors_and_many_images(spark, docs):
    t = ["abc " * 500, None]
    media = M.to_media(docs(t), ["doc_id"], chunk_bytes=100)
    rows = {r["doc_id"]: r for r in M.to_tensors(media, ["doc_id"]).collect()}
    assert (rows[0]["height"], rows[0]["width"], len(rows[0]["rgb"])) == (96, 16, 96 * 16 * 3) and rows[1]["height"] == 16
    most, M.MOST = M.MOST, 3
    try:
        text = bytes(range(32, 127)) * 60
        stored = M.store(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        read = M.Read(stored)
        assert len(read.images) > 3 and bytes(read.payloads()[0]) == payload(text.decode())
        slow = np.concatenate([P.tensor(read.coefs[b : b + x.layout.blocks], x) for b, x in zip(read.base, read.images)])
        assert (slow == read.tensors()[0]).all()
    finally:
        M.MOST = most
