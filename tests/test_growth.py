"""What must not grow faster than the input: shuffles, broadcasts, memory of workers, tasks."""

import pyarrow as pa
from pyspark.sql import functions as F

from loomdex.operators import code as C
from loomdex.operators import graph as G
from loomdex.operators import retrieve as R
from loomdex.operators import segment as S
from loomdex.plans import queries_code as QC
from loomdex.plans import queries_retrieval as Q


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_meet_in_their_own_row(spark):
    rows = spark.createDataFrame([(1, "b a b, B c a"), (2, None), (3, ""), (4, "z")], "id long, content string")
    index = R.postings(rows)
    assert "Exchange" not in plan_of(index)
    assert {tuple(r) for r in index.collect()} == {("a", 1, 2, 6), ("b", 1, 3, 6), ("c", 1, 1, 6), ("z", 4, 1, 1)}
    assert R.index_stats(rows, index) == R.lengths(rows) == (4, 7 / 4)
    assert R.index_stats(rows.limit(0), index.limit(0)) == (0, 1.0)


def test_no_index_is_built_for_what_reads_none(spark, sf, monkeypatch):
    def refuse(*_):
        raise AssertionError("an index was built")

    monkeypatch.setattr(Q, "_INDEXED", {})
    monkeypatch.setattr(Q.S, "indexed", refuse)
    assert Q.store_status(spark, sf).count() == 1
    assert Q.packed_search(spark, sf).count() == 10
    assert Q.vector_mode_by_distance(spark, sf).count() == 10


def test_a_parser_gives_blocks_of_bounded_size():
    batch = pa.RecordBatch.from_pydict({"file_path": ["a", "b", None], "content": ["x" * 50, None, "y"]})
    fields = pa.schema([("file_path", pa.string()), ("n", pa.int32()), ("s", pa.string())])
    parse = lambda c, p: ((i, c * 10_000) for i in range(10))
    got = list(S.blocks(batch, parse, fields))
    assert max(b.nbytes for b in got) <= 4 * S.BLOCK_CHARS
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert [(p, n) for p, n, _ in rows] == [(p, i) for p in ("a", "b", None) for i in range(10)] and rows[-1][2] == "y" * 10_000
    many = list(S.blocks(batch, lambda c, p: ((i, "") for i in range(3 * S.BLOCK_ROWS)), fields))
    assert max(b.num_rows for b in many) == S.BLOCK_ROWS and sum(b.num_rows for b in many) == 9 * S.BLOCK_ROWS


def test_calls_know_their_symbol_without_a_join(spark, sf):
    got = QC.code_calls(spark, sf)
    assert "Join" not in plan_of(got) and got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    source = "import a\n\nclass A:\n    def f(self):\n        g(1)\n        def h():\n            k.l()\n        h()\n\nm()\n"
    rows = spark.createDataFrame([("x.py", source), ("y.java", "class B {\n  int f() {\n    a.b();\n  }\n}\n"), ("z.txt", "f()")], "file_path string, content string")
    joined = G.enclosing_symbol(C.call_sites(rows), C.symbols(rows)).select("file_path", "callee", "receiver", "line", "symbol")
    one = C.enclosed_calls(rows)
    assert sorted(map(str, one.collect())) == sorted(map(str, joined.collect())) and one.count() == 6


def test_segments_are_dealt_over_the_cores(spark):
    x = spark.range(400).selectExpr("id div 10 conv_id", "id % 10 exchange", "'a question' user", "'an answer' assistant")
    got = S.conversation_segments(x, x.selectExpr("conv_id", "exchange", "0.0D score"))
    spread = got.withColumn("part", F.spark_partition_id()).select("part").distinct().count()
    assert spread > spark.sparkContext.defaultParallelism and got.select("conv_id").distinct().count() == 40


def test_rounds_broadcast_no_vertices(spark, monkeypatch):
    """One broadcast a level, of a row a codebase."""
    plans, write = [], G.materialise

    def seen(df, what):
        plans.append((what, plan_of(df)))
        return write(df, what)

    monkeypatch.setattr(G, "materialise", seen)
    rows = [("repo", f"{c}{i}", f"{c}{j}", "calls") for c in "ab" for i in range(4) for j in range(i)] + [("repo", "a0", "b0", "calls")]
    e = spark.createDataFrame(rows, "codebase string, source_file string, target_file string, edge_type string")
    got = {r["file_path"]: r["community_id"] for r in G.moved_in_rounds(G.collapsed(e), levels=2).collect()}
    assert len(set(got.values())) == 2 and all(got[f"{c}0"] == got[f"{c}{i}"] for c in "ab" for i in range(4))
    assert sum(p.count("BroadcastExchange") for _, p in plans) <= sum(w == "labels" for w, _ in plans)
