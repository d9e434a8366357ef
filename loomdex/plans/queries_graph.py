"""Graph queries over edges derived from the order tables: customers, suppliers and parts as files of two codebases."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdex.operators import graph as G
from loomdex.plans import search as S
from loomdex.plans.queries_retrieval import bm25_sql
from loomdex.runtime import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _largest(spark, sf, name, key):
    return table(spark, sf, name).agg(F.coalesce(F.max(key), F.lit(1)).cast("long")).first()[0]


def edges(spark, sf):
    """All parts and suppliers: p(i) -> p(3i mod P + 1), p(i) -> s(i mod S + 1), s(i) -> n(its nation), P and S the largest keys,
    with types by number."""
    parts, suppliers = _largest(spark, sf, "part", "p_partkey"), _largest(spark, sf, "supplier", "s_suppkey")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    kind = lambda n: F.element_at(F.array(*map(F.lit, ("calls", "import", "extends"))), (n % 3 + 1).cast("int"))
    name = lambda x, n: F.concat(F.lit(x + "/"), n.cast("string"), F.lit(".java"))
    a = p.select(name("p", F.col("k")).alias("source_file"), name("p", F.col("k") * 3 % parts + 1).alias("target_file"), kind(F.col("k")).alias("edge_type"), (F.col("k") * 4).alias("id"))
    b = p.select(name("p", F.col("k")).alias("source_file"), name("s", F.col("k") % suppliers + 1).alias("target_file"), kind(F.col("k") + 1).alias("edge_type"), (F.col("k") * 4 + 1).alias("id"))
    c = table(spark, sf, "supplier").select(name("s", F.col("s_suppkey")).alias("source_file"), name("n", F.col("s_nationkey")).alias("target_file"), F.lit("import").alias("edge_type"), (F.col("s_suppkey") * 4 + 2).alias("id"))
    return a.unionByName(b).unionByName(c).withColumns({"codebase": F.lit("repo"), "metadata": F.lit(None).cast("string"), "updated_at": F.col("id"), "confidence": F.lit(None).cast("double")})


EDGES = """e AS (
  SELECT 'p/' || p_partkey || '.java' AS s, 'p/' || (p_partkey * 3 % (SELECT max(p_partkey) FROM part) + 1) || '.java' AS t, ['calls', 'import', 'extends'][p_partkey % 3 + 1] AS k, p_partkey * 4 AS id FROM part
  UNION ALL SELECT 'p/' || p_partkey || '.java', 's/' || (p_partkey % (SELECT max(s_suppkey) FROM supplier) + 1) || '.java', ['calls', 'import', 'extends'][(p_partkey + 1) % 3 + 1], p_partkey * 4 + 1 FROM part
  UNION ALL SELECT 's/' || s_suppkey || '.java', 'n/' || s_nationkey || '.java', 'import', s_suppkey * 4 + 2 FROM supplier)"""


def symbols(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.concat(F.lit("repo:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("repo").alias("codebase"), F.concat(F.lit("p/"), F.col("p_partkey").cast("string"), F.lit(".java")).alias("file_path"), F.col("p_name").alias("name"), F.lit("class").alias("kind"), F.col("p_size").alias("start_line"), (F.col("p_size") + 10).alias("end_line"), F.concat(F.lit('{"label":"'), F.col("p_brand"), F.lit('"}')).alias("metadata"))


def start(spark, file):
    return spark.range(1).select(F.lit("repo").alias("codebase"), F.lit(file).alias("file"))


REACH = """WITH RECURSIVE %s, r(f, d) AS (
  SELECT 'p/7.java', 0 UNION SELECT %s, d + 1 FROM r JOIN e ON %s = f %s WHERE d < 4)
SELECT 'repo' AS codebase, f AS file, min(d)::INT AS depth FROM r WHERE f <> 'p/7.java' GROUP BY f"""


@query(REACH % (EDGES, "t", "s", ""))
def bfs_reach(spark, sf):
    return G.reach(edges(spark, sf), start(spark, "p/7.java"), max_depth=4)


@query(REACH % (EDGES, "s", "t", ""))
def bfs_upstream(spark, sf):
    return G.reach(edges(spark, sf), start(spark, "p/7.java"), "upstream", max_depth=4)


@query(REACH % (EDGES, "t", "s", "AND k IN ('calls', 'import')"))
def bfs_typed(spark, sf):
    return G.reach(edges(spark, sf), start(spark, "p/7.java"), edge_types=["calls", "import"], max_depth=4)


@query(f"""WITH RECURSIVE {EDGES}, r(f, p) AS (
  SELECT 'p/7.java', ['p/7.java'] UNION ALL SELECT t, list_append(p, t) FROM r JOIN e ON s = f WHERE len(p) <= 4 AND NOT list_contains(p, t)),
b AS (SELECT f, p, row_number() OVER (PARTITION BY f ORDER BY len(p), p) AS k FROM r WHERE len(p) > 1)
SELECT f AS file, (len(p) - 1)::INT AS depth, array_to_string(p, '>') AS path FROM b WHERE k = 1""")
def path_enum(spark, sf):
    return G.paths(edges(spark, sf), "p/7.java", max_depth=4).select("file", "depth", F.array_join("path", ">").alias("path"))


@query(f"""WITH RECURSIVE {EDGES}, st AS (SELECT 'p/' || p_partkey || '.java' AS f FROM part WHERE p_name = (SELECT p_name FROM part WHERE p_partkey = 7)),
r(f, p) AS (SELECT f, [f] FROM st UNION ALL SELECT t, list_append(p, t) FROM r JOIN e ON s = f WHERE len(p) <= 3 AND NOT list_contains(p, t)),
b AS (SELECT f, p, row_number() OVER (PARTITION BY f ORDER BY len(p), p) AS k FROM r WHERE f NOT IN (SELECT f FROM st))
SELECT 'repo' AS codebase, f AS file, (len(p) - 1)::INT AS depth, array_to_string(p, '>') AS path FROM b WHERE k = 1 ORDER BY depth, file LIMIT 50""")
def graph_traverse(spark, sf):
    """From all files that define a symbol of one name."""
    first = table(spark, sf, "part").filter("p_partkey = 7").first()["p_name"]
    got = G.graph_traverse(edges(spark, sf), symbols(spark, sf), first, "repo", max_depth=3, include_paths=True)
    return got.select("codebase", "file", "depth", F.array_join("path", ">").alias("path"))


@query(f"WITH {EDGES} SELECT 'repo' AS codebase, f AS file, count(*) AS degree FROM (SELECT s AS f FROM e UNION ALL SELECT t FROM e WHERE t <> s) GROUP BY f")
def degree(spark, sf):
    return G.degree(edges(spark, sf))


@query(f"""WITH {EDGES}, d AS (SELECT t, count(*) AS n FROM e GROUP BY t)
SELECT 's/' || s_suppkey || '.java' AS file_path, coalesce(n, 0) AS in_degree, round((1.0 / (1 + s_suppkey)) * (1 + ln(1 + coalesce(n, 0)) * 0.1), 9) AS score FROM supplier LEFT JOIN d ON t = 's/' || s_suppkey || '.java'""")
def indegree_rerank(spark, sf):
    scored = table(spark, sf, "supplier").select(F.concat(F.lit("s/"), F.col("s_suppkey").cast("string"), F.lit(".java")).alias("file_path"), (1.0 / (1 + F.col("s_suppkey"))).alias("score"))
    return G_boost(scored, edges(spark, sf))


def G_boost(scored, e):
    from loomdex.operators.retrieve import boost_by_degree

    return boost_by_degree(scored, e).select("file_path", "in_degree", F.round("score", 9).alias("score"))


@query(f"WITH {EDGES} SELECT s AS source_file, t AS target_file, k AS edge_type FROM e WHERE s = 'p/12.java' ORDER BY 1, 2, 3 LIMIT 50")
def dep_imports(spark, sf):
    return G.dependency_search(edges(spark, sf), "p/12.java", "repo").select("source_file", "target_file", "edge_type")


@query(f"WITH {EDGES} SELECT s AS source_file, t AS target_file, k AS edge_type FROM e WHERE t = 's/2.java' AND k = 'import' ORDER BY 1, 2, 3 LIMIT 20")
def dep_imported_by(spark, sf):
    return G.dependency_search(edges(spark, sf), "s/2.java", "repo", "imported_by", "import", 20).select("source_file", "target_file", "edge_type")


def builds(spark, sf):
    """Each order as a dependency of its customer's repository: on a build artifact, or on another customer's repository."""
    o = table(spark, sf, "orders")
    build = F.col("o_orderkey") % 3 == 0
    artifact = F.concat(F.lit("org.x:Lib-"), (F.col("o_orderkey") % 50).cast("string"), F.lit(":1"))
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("r"), (F.col("o_custkey") % 100).cast("string")).alias("codebase"), F.lit("pom.xml").alias("source_file"), F.when(~build, artifact).alias("target_file"), F.when(build, "build_dependency").otherwise("repo_dependency").alias("edge_type"), artifact.alias("metadata"), F.col("o_orderkey").alias("updated_at"))


BUILDS = """o AS (SELECT 'r' || (o_custkey % 100) AS codebase, 'org.x:Lib-' || (o_orderkey % 50) || ':1' AS artifact, o_orderkey % 3 = 0 AS build FROM orders)"""


@query(f"WITH {BUILDS} SELECT codebase, artifact AS metadata FROM o WHERE build AND artifact ILIKE '%lib-3%' ORDER BY 1, artifact LIMIT 40")
def dep_depended_on_by(spark, sf):
    """All rows of a codebase are alike but for the artifact, so the first 40 are taken by both."""
    got = G.dependency_search(builds(spark, sf), "LIB-3", direction="depended_on_by", max_results=10**6)
    return got.orderBy("codebase", "metadata").limit(40).select("codebase", "metadata")


@query(f"WITH {BUILDS} SELECT codebase, artifact AS target_file FROM o WHERE NOT build AND codebase = 'r7' ORDER BY 2 LIMIT 50")
def dep_repo_depends_on(spark, sf):
    return G.dependency_search(builds(spark, sf), "r7", direction="repo_depends_on").select("codebase", "target_file")


@query(f"WITH {BUILDS} SELECT codebase, artifact AS target_file FROM o WHERE NOT build AND artifact ILIKE '%lib-49:%' ORDER BY 1, 2 LIMIT 50")
def dep_repo_depended_on_by(spark, sf):
    return G.dependency_search(builds(spark, sf), "lib-49:", direction="repo_depended_on_by").select("codebase", "target_file")


@query(f"WITH {BUILDS} SELECT codebase, count(*) AS edge_count FROM o WHERE NOT build GROUP BY 1")
def repo_dependencies(spark, sf):
    return G.repo_dependencies(builds(spark, sf))


@query("""WITH m AS (SELECT 'r' || (p_partkey % 7) AS codebase, count(*) AS files, max(DATE '2024-01-01' + (p_size)::INT) AS last_indexed FROM part GROUP BY 1),
d AS (SELECT 'r' || (doc_id % 5) AS codebase, count(*) AS chunks FROM documents GROUP BY 1)
SELECT codebase, files, last_indexed, coalesce(chunks, 0) AS chunks FROM m LEFT JOIN d USING (codebase)""")
def codebases(spark, sf):
    """Documents as chunks of five codebases out of seven."""
    p, d = table(spark, sf, "part"), table(spark, sf, "documents")
    name = lambda c, n: F.concat(F.lit("r"), (F.col(c) % n).cast("string"))
    meta = p.select(name("p_partkey", 7).alias("codebase"), F.col("p_partkey").cast("string").alias("file_path"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")).alias("indexed_at"))
    chunks = d.select(F.concat(F.lit("codebase:"), name("doc_id", 5), F.lit("/a.java")).alias("file_path"))
    return S.codebases(meta, chunks)


@query("SELECT p_partkey AS k, p_name AS name, p_brand AS label FROM part WHERE p_name ILIKE '%re%' ORDER BY 'p/' || p_partkey || '.java', p_size, p_name LIMIT 25")
def symbol_like(spark, sf):
    got = G.symbol_search(symbols(spark, sf), "%re%", "repo", "class", 25)
    return got.select(F.regexp_extract("file_path", r"(\d+)", 1).cast("long").alias("k"), "name", "label")


def regions(spark, sf):
    """Communities by the region of a supplier's nation; parts go with their supplier."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    own = s.select(F.concat(F.lit("s/"), F.col("s_suppkey").cast("string"), F.lit(".java")).alias("file_path"), F.col("n_regionkey").alias("community_id"), F.col("s_suppkey"))
    p = table(spark, sf, "part").join(own.select("s_suppkey", "community_id"), F.col("p_partkey") % _largest(spark, sf, "supplier", "s_suppkey") + 1 == F.col("s_suppkey"))
    return own.select("file_path", "community_id").unionByName(p.select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string"), F.lit(".java")).alias("file_path"), "community_id")).withColumn("codebase", F.lit("repo"))


REGIONS = """own AS (SELECT 's/' || s_suppkey || '.java' AS f, n_regionkey AS c, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT f, c FROM own UNION ALL SELECT 'p/' || p_partkey || '.java', c FROM part JOIN own ON p_partkey % (SELECT max(s_suppkey) FROM supplier) + 1 = s_suppkey)"""


@query(f"WITH {EDGES}, {REGIONS} SELECT s AS source_file, t AS target_file, k AS edge_type, a.c AS source_community, b.c AS target_community FROM e JOIN m a ON a.f = s JOIN m b ON b.f = t WHERE a.c <> b.c ORDER BY 1, 2, 3 LIMIT 200")
def community_bridges(spark, sf):
    return G.bridges(edges(spark, sf), regions(spark, sf)).drop("codebase")


@query(f"""WITH {EDGES}, {REGIONS}, d AS (SELECT f, count(*) AS n FROM (SELECT s AS f FROM e UNION ALL SELECT t FROM e WHERE t <> s) GROUP BY f),
r AS (SELECT m.c, m.f, row_number() OVER (PARTITION BY m.c ORDER BY coalesce(n, 0) DESC, m.f) AS k FROM m LEFT JOIN d USING (f))
SELECT m.c AS community_id, count(*) AS members, (SELECT array_to_string(list(f ORDER BY k), ',') FROM r WHERE r.c = m.c AND k <= 3) AS top_files FROM m GROUP BY m.c""")
def community_top3(spark, sf):
    return G.community_list(edges(spark, sf), regions(spark, sf)).select("community_id", "members", F.array_join("top_files", ",").alias("top_files"))


@query()
def louvain(spark, sf):
    return G.communities(edges(spark, sf))


def _votes(n: int) -> str:
    return f"""v{n} AS (SELECT v, arg_min(label, (-n, label)) AS label FROM (SELECT v, label, sum(n) AS n FROM (SELECT p.a AS v, l.label, 1 AS n FROM p JOIN v{n - 1} l ON l.v = p.b UNION ALL SELECT v, label, 1 FROM v{n - 1}) GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH {EDGES}, h AS (SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b FROM e WHERE s <> t), p AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
v0 AS (SELECT DISTINCT a AS v, a AS label FROM p), {", ".join(map(_votes, range(1, 5)))} SELECT 'repo' AS codebase, v AS file_path, label FROM v4""")
def label_propagation(spark, sf):
    return G.label_propagation(edges(spark, sf), 4)


@query(f"WITH {EDGES}, {REGIONS}, d AS (SELECT f, count(*) AS n FROM (SELECT s AS f FROM e UNION ALL SELECT t FROM e WHERE t <> s) GROUP BY f) SELECT m.c AS community_id, m.f AS file_path, coalesce(n, 0) AS degree FROM m LEFT JOIN d USING (f) WHERE m.c = (SELECT c FROM m WHERE f = 's/3.java')")
def community_members(spark, sf):
    return G.community_members(edges(spark, sf), regions(spark, sf), "repo", "s/3.java").drop("codebase")


@query(f"WITH {EDGES} SELECT 'repo' AS codebase, abs(count(*) - 2500) / 2500.0 > 0.10 AS stale FROM e")
def drift_check(spark, sf):
    stored = spark.range(1).select(F.lit("repo").alias("codebase"), F.lit(2500).alias("edge_count"))
    return G.drifted(stored, edges(spark, sf))


@query(f"WITH {EDGES}, d AS (SELECT t, count(*) AS n FROM e GROUP BY t) SELECT 'repo:' || p_partkey AS id, n AS in_degree FROM part JOIN d ON t = 'p/' || p_partkey || '.java' WHERE n >= 1")
def high_value_nodes(spark, sf):
    return G.high_value(symbols(spark, sf), edges(spark, sf), "repo", 1).select("id", "in_degree")


@query("""WITH n AS (SELECT lower(n_name) AS name FROM nation), w AS (SELECT DISTINCT lower(r_name) AS a FROM region UNION SELECT lower(left(n_name, 3)) FROM nation),
b AS (SELECT a, name, row_number() OVER (PARTITION BY a ORDER BY (name <> a)::INT, -length(name), name) AS k FROM w JOIN n ON contains(name, a))
SELECT a AS artifact, 'codebase:' || name || '/' AS target_file FROM b WHERE k = 1""")
def cross_repo_resolve(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    names = r.select(F.lower("r_name").alias("a")).union(n.select(F.lower(F.substr("n_name", F.lit(1), F.lit(3))))).distinct()
    wanted = names.select(F.xxhash64("a").alias("id"), F.lit("app").alias("codebase"), F.lit("pom.xml").alias("source_file"), F.lit("build_dependency").alias("edge_type"), F.concat(F.lit("org.x:"), "a", F.lit(":1.0")).alias("metadata"), F.lit(None).cast("string").alias("target_file"))
    got = G.resolve_dependencies(wanted, n.select(F.lower("n_name").alias("codebase")))
    return got.select(F.get(F.split("metadata", ":"), F.lit(1)).alias("artifact"), "target_file")


@query("""SELECT 'p/' || p_partkey AS source_file, arg_min('n/' || n_nationkey || '.java', n_nationkey) AS target_file
FROM part JOIN nation ON n_name = (SELECT n_name FROM nation x WHERE x.n_nationkey = p_partkey % 25) GROUP BY p_partkey""")
def resolve_types(spark, sf):
    n = table(spark, sf, "nation")
    there = n.select(F.col("n_name").alias("name"), F.lit("lib").alias("codebase"), F.concat(F.lit("n/"), F.col("n_nationkey").cast("string"), F.lit(".java")).alias("file_path"), F.lit(1).alias("start_line"))
    p = table(spark, sf, "part").join(n, F.col("p_partkey") % 25 == F.col("n_nationkey"))
    e = p.select(F.col("p_partkey").alias("id"), F.lit("app").alias("codebase"), F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("source_file"), F.lit("extends").alias("edge_type"), F.concat(F.lit("com.x."), "n_name").alias("metadata"), F.lit(None).cast("string").alias("target_file"))
    return G.resolve_types(e, there).select("source_file", "target_file")


CALLS = """c AS (SELECT p_partkey AS call_id, 'm' || (p_partkey % 7) AS dir, p_name AS name, p_partkey % 50 = 0 AS odd FROM part),
i AS (SELECT 'm' || (p_partkey % 7) AS dir, p_name AS name FROM part WHERE p_partkey % 11 = 0),
s AS (SELECT DISTINCT p_name AS name, 'm' || (p_partkey % 9) AS dir, 'm' || (p_partkey % 9) || '/f' || p_partkey || '.java' AS target FROM part),
u AS (SELECT name, min(target) AS target FROM s GROUP BY 1 HAVING count(DISTINCT target) = 1),
h AS (SELECT call_id, 1 AS p, 'lib/x.java' AS t FROM c JOIN i USING (dir, name) WHERE NOT odd
  UNION ALL SELECT call_id, 3, min(s.target) FROM c JOIN s USING (dir, name) WHERE NOT odd GROUP BY 1
  UNION ALL SELECT call_id, 4, u.target FROM c JOIN u USING (name) WHERE NOT odd
  UNION ALL SELECT call_id, 5, min(s.target) FROM c JOIN s USING (name) WHERE NOT odd GROUP BY 1)"""


@query(f"""WITH {CALLS} SELECT call_id, arg_min(t, p) AS target_file, ['import_exact', '', 'same_module', 'unique_name', 'nearest'][min(p)] AS strategy FROM h GROUP BY 1""")
def resolve_calls_by_name(spark, sf):
    """The calls whose name is a symbol's own: all folders are one deep, so any folder but the caller's is as near."""
    got = resolve_calls(spark, sf)
    return got.filter("call_id % 50 <> 0").select("call_id", "target_file", "strategy")


@query()
def resolve_calls(spark, sf):
    p = table(spark, sf, "part")
    symbols_ = p.select(F.col("p_name").alias("short"), F.concat(F.lit("m"), (F.col("p_partkey") % 9).cast("string"), F.lit("/f"), F.col("p_partkey").cast("string"), F.lit(".java")).alias("file_path"))
    calls = p.select(F.col("p_partkey").alias("call_id"), F.concat(F.lit("m"), (F.col("p_partkey") % 7).cast("string"), F.lit("/c.java")).alias("source_file"), F.when(F.col("p_partkey") % 50 == 0, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name")).alias("callee"), F.lit("").alias("receiver"))
    imports = p.filter("p_partkey % 11 = 0").select(F.concat(F.lit("m"), (F.col("p_partkey") % 7).cast("string"), F.lit("/c.java")).alias("source_file"), F.col("p_name").alias("name"), F.lit("lib/x.java").alias("target_file"))
    return G.resolve_calls(calls, imports, symbols_)


@query(f"""WITH {bm25_sql(["the", "render"])}, {EDGES},
k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 30),
d AS (SELECT t, count(*) AS n FROM e GROUP BY t),
x AS (SELECT k.id, rank, coalesce(n, 0) AS in_degree, 1.0::DOUBLE / (60 + rank) * (1 + ln(1 + coalesce(n, 0)) * 0.1) AS score, p_brand AS label FROM k LEFT JOIN d ON t = 'p/' || k.id || '.java' LEFT JOIN part ON p_partkey = k.id)
SELECT id, 'p/' || id || '.java' AS rel_path, round(score, 9) AS score, in_degree, label FROM x ORDER BY x.score DESC, rank, id LIMIT 10""")
def codebase_search(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit("").alias("title"), F.concat(F.lit("codebase:repo/p/"), F.col("doc_id").cast("string"), F.lit(".java")).alias("file_path"))
    got = S.codebase_search(S.Catalog(rows, edges=edges(spark, sf), symbols=symbols(spark, sf)), "the render", "repo")
    return got.select("id", "rel_path", F.round("score", 9).alias("score"), "in_degree", "label")
