import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.functions import entities as E
from loomdex.functions import vectors as V
from loomdex.operators import evaluate, retrieve as R
from loomdex.plans import search as S

TEXTS = ["the quick brown fox", "a foo_bar b foo bar", "foo baz bar", "the the the end", "quick foo quick", "nothing here", "bar foo foo bar fox", "brown brown fox the"]


@pytest.mark.parametrize("q", ["quick fox", "foo_bar", "the", "foo foo bar", "zzz"])
def test_bm25_equals_full_text_index(spark, q):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(content, title)")
    db.executemany("insert into t(rowid, content, title) values (?, ?, ?)", [(i, x, f"t{i} fox") for i, x in enumerate(TEXTS)])
    want = {r: -s for r, s in db.execute("select rowid, rank from t where t match ?", (R.match_expression(q),))}
    rows = spark.createDataFrame([(i, x, f"t{i} fox") for i, x in enumerate(TEXTS)], "id long, content string, title string")
    got = {r["id"]: r["score"] for r in R.bm25(rows, q, columns={"content": 1.0, "title": 1.0}).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fusion(spark):
    ranked = lambda ids, n: spark.createDataFrame([(x, n, i + 1) for i, x in enumerate(ids)], "id string, list_no int, rank int")
    got = {r["id"]: r["score"] for r in R.fuse([ranked("abc", 0), ranked("bda", 1)]).collect()}
    want = {"a": 1 / 61 + 1 / 63, "b": 1 / 62 + 1 / 61, "c": 1 / 63, "d": 1 / 62}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-10 for k in want)


def test_temporal(spark):
    rows = spark.createDataFrame([(f"chunk-{d}", f"2025-01-{d:02d}") for d in range(1, 21)], "id string, d string").select("id", F.to_date("d").alias("event_date"))
    got = [r["id"] for r in R.temporal_scores(rows, "2025-01-10", 10).collect()]
    assert got[0] == "chunk-10" and set(got[:3]) == {"chunk-10", "chunk-9", "chunk-11"}


def test_entity_overlap(spark):
    found = spark.createDataFrame([("both", "tool", "slack"), ("both", "tool", "jira"), ("one", "tool", "slack")], "chunk_id string, entity_type string, entity_value string")
    got = {r["id"]: r["score"] for r in R.entity_scores(found, [("tool", "slack"), ("tool", "jira")]).collect()}
    assert got == {"both": 1.0, "one": 0.5}


def test_quantizer():
    x = np.random.RandomState(123).randn(1000, 384)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = V.Quantizer(384, 4)
    code = q.encode(x)
    assert code.shape[1] == V.packed_size(384, 4) == 192
    assert ((q.decode(code) - x) ** 2).sum(axis=1).mean() <= 0.02
    assert np.abs(q.rotation.inverse(q.rotation.forward(x)) - x).max() < 1e-9
    approx = q.rotated(code) @ q.rotation.forward(x[:20]).T
    assert np.abs(approx - x @ x[:20].T).max() < 0.12
    hits = [len(set(np.argsort(-approx[:, i])[:30]) & set(np.argsort(-(x @ x[i]))[:10])) / 10 for i in range(20)]
    assert np.mean(hits) >= 0.95
    for bits in (1, 2, 3, 4, 8):
        codes = np.random.RandomState(1).randint(0, 1 << bits, (5, 37))
        assert (V.unpack(V.pack(codes, bits), 37, bits) == codes).all()


def test_sign_codes_and_truncation(spark):
    rng = np.random.RandomState(0)
    a, b = rng.randn(70), rng.randn(70)
    lit = lambda v: F.array(*(F.lit(float(x)) for x in v))
    row = spark.range(1).select(V.hamming(V.sign_code(lit(a)), V.sign_code(lit(b))).alias("h"), V.truncated(lit(a), 16).alias("t"), V.cosine(lit(a), lit(b)).alias("c")).first()
    assert row["h"] == int(((a > 0) != (b > 0)).sum())
    assert np.allclose(row["t"], a[:16] / np.linalg.norm(a[:16])) and abs(row["c"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-9


def test_search_filters_and_cap(spark):
    rows = [(f"{c}:{i}", f"conversations/p{c}/{c}.jsonl", f"proj{c} | 2024-01-0{c}", "alpha beta " * (i + 1)) for c in (1, 2, 3) for i in range(4)] + [("m", "memory/2024-01-05.md", "note", "alpha")]
    catalog = S.Catalog(spark.createDataFrame(rows, "id string, file_path string, title string, content string"))
    got = S.memory_search(catalog, "alpha", 20).collect()
    assert max(sum(r["path"] == str(c) for r in got) for c in (1, 2, 3)) == 2 and any(r["id"] == "m" for r in got)
    got = S.memory_search(catalog, "alpha", 20, after="2024-01-02", before="2024-01-05", project="proj2").collect()
    assert {r["path"] for r in got} == {"2", "memory/2024-01-05.md"}
    assert {r["source"] for r in S.memory_search(catalog, "alpha", 20, source="curated", compat=True).collect()} == {"curated"}
    assert S.memory_search(catalog, "!!", 5).count() == 0
    assert S.memory_search(catalog, "alpha", 5, min_score=0.5).count() == 0


def test_addons(spark):
    found = spark.createDataFrame([("x", "/local/x", 0, "m"), ("x", "/plugin/x", 1, "m"), ("y", "/plugin/y", 1, "other"), ("z", "/plugin/z", 1, None)], "stem string, path string, precedence int, model string")
    assert {r["path"] for r in S.choose_addons(found, "m").collect()} == {"/local/x", "/plugin/z"}


def test_recall(spark):
    relevant = spark.createDataFrame([("q1", "a", ["1", "2"]), ("q2", "a", ["3"]), ("q3", "b", ["4", "5", "6"])], "query_id string, category string, ids array<string>")
    results = spark.createDataFrame([("q1", "1", 1), ("q1", "2", 7), ("q2", "3", 2), ("q3", "4", 5)], "query_id string, id string, rank int")
    got = {r["category"]: (r["r5"], r["r10"]) for r in evaluate.recall(results, relevant).collect()}
    assert got == {"a": (0.75, 1.0), "b": (0.333, 0.333), "overall": (0.611, 0.778)}


def test_refinement(spark):
    rows = spark.createDataFrame([("t1",), ("t2",)], "transcript string")
    judge = lambda t, s: F.concat(F.lit("SCORE: "), F.when(s.contains("better") | (t == "t2"), "9").otherwise("5"), F.lit("/10\nFEEDBACK: better"))
    got = {r["transcript"]: (r["summary"], r["score"], r["rounds"]) for r in evaluate.refined(rows, lambda t: t, judge, lambda t, s, f: F.concat(s, F.lit(" "), f)).collect()}
    assert got == {"t1": ("t1 better", 9.0, 1), "t2": ("t2", 9.0, 0)}


def store(spark):
    """Chunks whose first pass names people that lead to others, over dates, projects and kinds of source."""
    rows = [
        ("a", "memory/2024-01-10.md", "n", "alpha plan by Ann Lee"),
        ("b", "memory/2024-01-12.md", "n", "Ann Lee likes tea"),
        ("c", "memory/2023-05-01.md", "n", "Ann Lee of old"),
        ("d", "conversations/p/1.jsonl", "proj1 | 2024-01-11", "Ann Lee spoke"),
        ("e", "conversations/q/2.jsonl", "proj2 | 2024-01-11", "Ann Lee again"),
        ("f", "codebase:x/y.py", "y", "Ann Lee in code"),
        ("g", "memory/2024-01-15.md", "z", "nothing of note"),
    ]
    chunks = spark.createDataFrame(rows, "id string, file_path string, title string, content string")
    return S.Catalog(chunks, entities=E.chunk_entities(chunks))


@pytest.mark.parametrize("ready", [False, True])
def test_deep_search_keeps_to_its_filters(spark, ready):
    catalog = S.indexed(store(spark)) if ready else store(spark)
    hops = lambda **k: {r["id"]: r["hop"] for r in S.memory_deep_search(catalog, "alpha", 10, **k).collect()}
    assert hops() == {"a": 0, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1}
    assert hops(max_hops=0) == {"a": 0}
    assert hops(after="2024-01-01", before="2024-01-11") == {"a": 0, "d": 1, "e": 1}
    assert hops(source="curated") == {"a": 0, "b": 1, "c": 1}
    assert hops(project="proj1") == {"a": 0, "b": 1, "c": 1, "d": 1, "f": 1}
    assert hops(after="2025-01-01") == {}
    assert hops(min_score=0.5) == {}


def test_deep_search_takes_entities_from_the_snippet(spark):
    chunks = spark.createDataFrame([("a", "memory/a.md", "n", "alpha " + "x " * 600 + "Ann Lee"), ("b", "memory/b.md", "z", "Ann Lee")], "id string, file_path string, title string, content string")
    got = S.memory_deep_search(S.Catalog(chunks, entities=E.chunk_entities(chunks)), "alpha", 10).collect()
    assert [r["id"] for r in got] == ["a"]


def test_index_gives_the_same_scores(spark):
    rows = spark.createDataFrame([(i, x, f"t{i} fox") for i, x in enumerate(TEXTS)], "id long, content string, title string")
    index, stats = R.postings(rows, columns=("title", "content")), R.lengths(rows, columns=("title", "content"))
    for q in ("quick fox", "the the", "foo bar foo", "zzz"):
        a, b = ({r["id"]: r["score"] for r in df.collect()} for df in (R.bm25(rows, q, columns={"content": 1.0, "title": 1.0}), R.bm25_indexed(index, stats, q)))
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_modes(spark):
    rng = np.random.RandomState(5)
    rows = [(i, f"word{i % 3} text", "t", rng.randn(8).tolist()) for i in range(30)]
    catalog = S.Catalog(spark.createDataFrame(rows, "id long, content string, title string, embedding array<double>"), embed=lambda q: rows[4][3])
    assert {r["match_type"] for r in S.search(catalog, "word1", "keyword", 50).collect()} == {"keyword"}
    near = [(r["id"], r["score"]) for r in S.search(catalog, "word1", "vector", 5, min_score=-99.0, metric="l2").collect()]
    gaps = sorted((float(np.linalg.norm(np.array(v) - rows[4][3])), i) for i, _, _, v in rows)[:5]
    assert [i for i, _ in near] == [i for _, i in gaps] and all(abs(s - (1 - g)) < 1e-9 for (_, s), (g, _) in zip(near, gaps))
    both = S.search(catalog, "word1", "hybrid", 10).collect()
    assert both[0]["id"] == 4 and both[0]["match_type"] == "hybrid" and len(both) == 10
    assert S.search(catalog, "word1", "hybrid", 0).count() == 0 and S.search(catalog, "!!", "keyword").count() == 0


def test_codes_and_float_vectors_are_fused(spark):
    rng = np.random.RandomState(8)
    x = rng.randn(60, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, "c", "t", v.tolist()) for i, v in enumerate(x)], "id long, content string, title string, embedding array<double>")
    codes = rows.filter("id % 2 = 0").select("id", V.quantize(F.col("embedding"), 64).alias("code4"))
    q = x[7].tolist()
    (got,) = S.vector_scores(S.Catalog(rows, codes=codes), rows, q, 10)
    ranks = {r["id"]: r["rank"] for r in got.collect()}
    back = np.array([list(r["v"]) for r in codes.orderBy("id").select(V.dequantize(F.col("code4"), 64).alias("v")).collect()])
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    lists = [sorted(((s, i) for s, i in zip(-(unit(back) @ x[7]), range(0, 60, 2)) if s < 0))[:10], sorted((s, i) for s, i in zip(-(x[1::2] @ x[7]), range(1, 60, 2)) if s < 0)[:10]]
    fused = {}
    for no, own in enumerate(lists):
        for rank, (_, i) in enumerate(own, 1):
            fused[i] = (-1 / (60 + rank), no, rank, i)
    assert ranks == {i: n for n, i in enumerate(sorted(fused, key=fused.get)[:10], 1)}


def test_any_encoding(spark):
    x = np.random.RandomState(1).randn(64)
    x /= np.linalg.norm(x)
    blobs = [(3 * x).astype("<f4").tobytes(), V.Quantizer(64, 4).encode(x[None])[0].tobytes(), str((2 * x).tolist()).encode(), b"[1, 2]", b"abc", None, np.zeros(64, "<f4").tobytes()]
    got = [r["v"] for r in spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "id int, b binary").orderBy("id").select(V.any_encoding(F.col("b"), 64).alias("v")).collect()]
    assert np.allclose(got[0], x, atol=1e-6) and np.dot(got[1], x) > 0.98 and np.allclose(got[2], x) and got[3:] == [None] * 4


def test_top_k_many_equals_brute_force(spark):
    x = np.random.RandomState(3).randint(-3, 4, (90, 4)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = R.top_k_many(rows, rows.filter("id % 9 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), 4, 4, query_rows=3, part_rows=20)
    want = {(q, i, k) for q in range(0, 90, 9) for k, (_, i) in enumerate(sorted((-(x[q] @ x[i]), i) for i in range(90) if i != q)[:4], 1)}
    assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == want
