"""Each registered query as it is called: column names, types and values over a whole small table."""

import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomdex.llm import pii, registry

public = pytest.importorskip("public_tokenizers")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def texts(sf):
    return {i: t or "" for i, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()}


@pytest.fixture(scope="module")
def run(spark, sf):
    kept = {}

    def get(name):
        if name not in kept:
            df = registry.queries()[name](spark, sf)
            kept[name] = ([(f.name, f.dataType.simpleString()) for f in df.schema], df.collect())
        return kept[name]

    return get


def begins(schema, want):
    assert schema[: len(want.split(", "))] == [tuple(c.split()) for c in want.split(", ")]


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(run, sf, name):
    schema, rows = run(name)
    db = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = db.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(c for c, _ in schema)
    assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(want.fetchall())


def test_op1(run, texts):
    from tokenizers import Tokenizer

    schema, rows = run("op1_token_codes")
    begins(schema, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    tok, start, want = Tokenizer.from_file(public.path("word_bpe_49k.json")), 0, []
    for i in sorted(texts):
        ids = np.array([*tok.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r)[:4] for r in rows) == want


def test_op4(run, texts, sf):
    schema, rows = run("op4_quality")
    begins(schema, "doc_id bigint, held_out boolean, score double, predicted int")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    label = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    held = [r for r in rows if r["held_out"] and r["doc_id"] in label]
    assert sum(r["predicted"] == label[r["doc_id"]] for r in held) >= 0.9 * len(held)
    by_text = {}
    for r in rows:
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())


def test_op5(run, texts):
    from test_pii import base

    schema, rows = run("op5_pii_boosting")
    begins(schema, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        found = base(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in found) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and (r["spans"] + ",").startswith(listed + "," if listed else "")


def test_op6(run, texts, sf):
    schema, rows = run("op6_temperature_mix")
    assert {c for c, _ in schema} >= {"doc_id", "source", "epoch", "block_order", "row_order"}
    source = dict(duckdb.sql(f"select doc_id, source from '{sf}/documents.parquet'").fetchall())
    words = {i: len(t.split()) for i, t in texts.items()}
    held = {}
    for i, s in source.items():
        held[s] = held.get(s, 0) + words[i]
    given = {}
    for r in rows:
        assert r["n_tokens"] == words[r["doc_id"]] and r["source"] == source[r["doc_id"]]
        given[r["source"]] = given.get(r["source"], 0) + words[r["doc_id"]]
    assert max(given[s] / held[s] for s in given) <= 2 + 1e-9
    longest = {s: max(words[i] for i in texts if source[i] == s) for s in held}  # a source's last pass ends before the row that doesn't fit
    assert sum(held.values()) - sum(longest.values()) <= sum(given.values()) <= sum(held.values())
    assert len({(r["doc_id"], r["epoch"]) for r in rows}) == len(rows)


def test_op9(run, texts):
    from loomdex.llm.piece_codec import codec

    schema, rows = run("op9_piece_codec")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and all(r["lossless"] for r in rows)
    own = codec(public.path("piece_bpe_32k.model"))
    for r in rows:  # each text alone
        ids, _ = own.encode(pa.array([texts[r["doc_id"]]]))
        assert r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids.astype("<u4").tobytes())


def test_pipeline(run, texts):
    schema, rows = run("pipeline")
    assert {"doc_id", "n_tokens", "ids"} <= {c for c, _ in schema} and 0 < len({r["doc_id"] for r in rows}) < len(texts)
