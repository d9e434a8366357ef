"""The graph queries take every row of their tables: more parts and suppliers than the smallest tables have."""

import pytest
from pyspark.sql import functions as F

from loomdex.plans import queries_graph as Q

PARTS, SUPPLIERS = 1500, 60


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('large')}"
    k = F.col("id").cast("long")
    one = lambda n: spark.range(1, n + 1)
    one(PARTS).select(k.alias("p_partkey"), F.concat(F.lit("part "), k.cast("string")).alias("p_name"), F.lit("b").alias("p_brand"), F.lit(1).alias("p_size")).write.parquet(f"{d}/part.parquet")
    one(SUPPLIERS).select(k.alias("s_suppkey"), (k % 25).cast("int").alias("s_nationkey")).write.parquet(f"{d}/supplier.parquet")
    spark.range(25).select(k.cast("int").alias("n_nationkey"), F.concat(F.lit("N"), k.cast("string")).alias("n_name"), (k % 5).cast("int").alias("n_regionkey")).write.parquet(f"{d}/nation.parquet")
    return d


def pairs():
    for k in range(1, PARTS + 1):
        yield f"p/{k}.java", f"p/{k * 3 % PARTS + 1}.java"
        yield f"p/{k}.java", f"s/{k % SUPPLIERS + 1}.java"
    for k in range(1, SUPPLIERS + 1):
        yield f"s/{k}.java", f"n/{k % 25}.java"


def test_edges_of_all_rows(spark, large):
    got = [(r["source_file"], r["target_file"]) for r in Q.edges(spark, large).collect()]
    assert sorted(got) == sorted(pairs())


def test_graph_queries_see_all_rows(spark, large):
    both = {}
    for a, b in pairs():
        both.setdefault(a, []).append(b)
        if a != b:
            both.setdefault(b, []).append(a)
    assert {r["file"]: r["degree"] for r in Q.degree(spark, large).collect()} == {f: len(x) for f, x in both.items()}
    into, want, last = {}, {}, {"p/7.java"}
    for a, b in pairs():
        into.setdefault(b, set()).add(a)
    for depth in range(1, 5):
        last = {a for f in last for a in into.get(f, ())} - set(want) - {"p/7.java"}
        want |= dict.fromkeys(last, depth)
    assert {r["file"]: r["depth"] for r in Q.bfs_upstream(spark, large).collect()} == want


def test_regions_of_all_rows(spark, large):
    got = {r["file_path"]: r["community_id"] for r in Q.regions(spark, large).collect()}
    own = {f"s/{k}.java": k % 25 % 5 for k in range(1, SUPPLIERS + 1)}
    assert got == own | {f"p/{k}.java": own[f"s/{k % SUPPLIERS + 1}.java"] for k in range(1, PARTS + 1)}


def test_types_of_all_parts(spark, large):
    got = {r["source_file"]: r["target_file"] for r in Q.resolve_types(spark, large).collect()}
    assert got == {f"p/{k}": f"n/{k % 25}.java" for k in range(1, PARTS + 1)}
