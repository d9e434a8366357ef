"""Source-code queries: files are written from the part table by Spark expressions, then parsed."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdex.operators import code as C
from loomdex.operators import graph as G
from loomdex.operators import segment as S
from loomdex.runtime import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def spread(rows):
    """Rows of a few bytes that become files to parse, dealt over all cores: a small table is one file, and would be one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def java(spark, sf):
    """A class for each part: it imports its supplier's class, extends the class of its size and calls its neighbour."""
    p = spread(table(spark, sf, "part").select("p_partkey", "p_size"))
    k = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    body = F.concat(F.lit("package app;\n\nimport lib.S"), k(F.col("p_partkey") % 40), F.lit(";\nimport java.util.*;\n\n/** class Hidden { } */\npublic class P"), k("p_partkey"), F.lit(" extends Base"), k("p_size"), F.lit(" implements Sold, Kept<String> {\n    private int n = 0;\n\n    public int run(int x) {\n        helper.step"), k(F.col("p_partkey") + 1), F.lit("(x);\n        return n + x;\n    }\n\n    protected String name() {\n        return \"p()\";\n    }\n}\n"))
    return p.select(F.concat(F.lit("src/main/java/app/P"), k("p_partkey"), F.lit(".java")).alias("file_path"), body.alias("content"))


@query("SELECT 'src/main/java/app/P' || p_partkey || '.java' AS file_path, 'lib.S' || (p_partkey % 40) AS name, 'import' AS edge_type FROM part UNION ALL SELECT 'src/main/java/app/P' || p_partkey || '.java', 'java.util', 'wildcard_import' FROM part")
def code_imports(spark, sf):
    return C.imports(java(spark, sf)).select("file_path", "name", "edge_type")


@query("WITH k AS (SELECT unnest([('', 'class', 7, 17), ('.run', 'method', 10, 13), ('.name', 'method', 15, 17)]) AS s) SELECT 'P' || p_partkey || s[1] AS name, s[2] AS kind, s[3]::INT AS start_line FROM part, k")
def code_symbols(spark, sf):
    return C.symbols(java(spark, sf)).select("name", "kind", "start_line")


@query("SELECT 'P' || p_partkey AS child, 'Base' || p_size AS parent, 'extends' AS edge_type FROM part UNION ALL SELECT 'P' || p_partkey, unnest(['Sold', 'Kept']), 'implements' FROM part")
def code_hierarchy(spark, sf):
    return C.hierarchy(java(spark, sf)).select("child", "parent", "edge_type")


@query("SELECT 'src/main/java/app/P' || p_partkey || '.java' AS file_path, 'step' || (p_partkey + 1) AS callee, 'helper' AS receiver, 'P' || p_partkey || '.run' AS symbol FROM part")
def code_calls(spark, sf):
    return C.enclosed_calls(java(spark, sf)).select("file_path", "callee", "receiver", "symbol")


@query("SELECT 'src/main/java/app/P' || p_partkey || '.java' AS file_path, 0 AS chunk_index, 'class P' || p_partkey AS title, 7 AS start_line FROM part")
def code_chunks(spark, sf):
    return S.code_chunks(java(spark, sf)).select("file_path", "chunk_index", "title", "start_line")


@query("SELECT 'src/main/java/app/P' || p_partkey || '.java' AS source_file, 'lib.S' || (p_partkey % 40) AS name, 'src/lib/S' || (p_partkey % 40) || '.java' AS target_file FROM part WHERE p_partkey % 40 < 30")
def import_resolution(spark, sf):
    found = C.imports(java(spark, sf)).filter("edge_type = 'import'").select(F.col("file_path").alias("source_file"), "name", F.lit("java").alias("language"))
    files = spark.range(30).select(F.concat(F.lit("src/lib/S"), F.col("id").cast("string"), F.lit(".java")).alias("file_path"))
    return G.import_candidates(files, found)


@query("""SELECT 's/' || s_suppkey || '/build.gradle.kts' AS file_path, 'com.acme' AS group_id, 'nation' || s_nationkey AS artifact, '1.' || s_suppkey AS version, 'api' AS scope, false AS is_internal, 'com.acme:nation' || s_nationkey || ':1.' || s_suppkey AS coordinate FROM supplier
UNION ALL SELECT 's/' || s_suppkey || '/build.gradle.kts', '', ':core:n' || s_nationkey, '', 'implementation', true, 'project::core:n' || s_nationkey FROM supplier
UNION ALL SELECT 's/' || s_suppkey || '/build.gradle.kts', 'org.lib', 'x', '2.0', 'testImplementation', false, 'org.lib:x:2.0' FROM supplier""")
def build_dependencies(spark, sf):
    s = spread(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"))
    k = lambda c: F.col(c).cast("string")
    gradle = s.select(F.concat(F.lit("s/"), k("s_suppkey"), F.lit("/build.gradle.kts")).alias("file_path"), F.concat(F.lit('dependencies {\n  api("com.acme:nation'), k("s_nationkey"), F.lit(":1."), k("s_suppkey"), F.lit('")\n  implementation(project(":core:n'), k("s_nationkey"), F.lit('"))\n  testImplementation(libs.x.y)\n}')).alias("content"))
    versions = spark.range(1).select(F.lit("gradle/libs.versions.toml").alias("file_path"), F.lit('[versions]\nv = "2.0"\n[libraries]\nx-y = { module = "org.lib:x", version.ref = "v" }\n').alias("content"))
    return C.dependencies(gradle.unionByName(versions)).drop("module_path")


@query("""SELECT 'c' || c_custkey || '.java' AS source_file, 'n' || c_nationkey || '.java' AS target_file, CASE WHEN c_nationkey % 2 = 0 THEN 'calls' ELSE 'extends' END AS edge_type FROM customer""")
def symbol_index_edges(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    symbol = lambda k: F.concat(F.lit("acme/N"), F.col(k).cast("string"), F.when(F.col(k) % 2 == 0, "run().").otherwise("#Type"))
    occurrence = lambda k, roles: F.array(F.struct(symbol(k).alias("symbol"), F.lit(roles).alias("symbolRoles")))
    uses = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".java")).alias("relativePath"), occurrence("c_nationkey", 0).alias("occurrences"))
    homes = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".java")).alias("relativePath"), occurrence("n_nationkey", 1).alias("occurrences"))
    index = uses.unionByName(homes).select(F.array(F.struct("relativePath", "occurrences")).alias("documents"))
    return G.index_edges(index).select("source_file", "target_file", "edge_type")


@query("""WITH e AS (SELECT 'c' || c_custkey AS s, 'n' || c_nationkey AS t, 'calls' AS k, 0.5 AS c, 1 AS p FROM customer UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'extends', 0.95, 0 FROM customer WHERE c_custkey % 3 = 0)
SELECT s AS source_file, t AS target_file, arg_min(k, p) AS edge_type, arg_min(c, p)::DOUBLE AS confidence FROM e GROUP BY s, t""")
def merged_edges(spark, sf):
    c = table(spark, sf, "customer")
    rows = lambda d, kind, conf: d.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source_file"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target_file"), F.lit(kind).alias("edge_type"), F.lit(conf).alias("confidence"))
    return G.merge_edges(rows(c, "calls", 0.5), rows(c.filter("c_custkey % 3 = 0"), "extends", 0.95))
