"""Change detection, queue and event-window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdex.functions import text as T
from loomdex.operators import evaluate as V
from loomdex.runtime import shared_path, table
from loomdex.streaming import jobs as J

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def snapshot(spark, sf, change: bool):
    """Documents as files; the later snapshot lacks every tenth, and every seventh has grown."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("file_path"), "text")
    if change:
        d = d.filter("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    else:
        d = d.filter("doc_id % 10 <> 3")
    return d.select("file_path", T.content_hash(F.col("text")).alias("hash"), F.col("text").alias("content"))


CHANGED = """SELECT 'd/' || doc_id AS file_path, CASE WHEN doc_id % 10 = 0 THEN 'D' WHEN doc_id % 10 = 3 THEN 'A' WHEN doc_id % 7 = 0 THEN 'M' END AS status FROM documents WHERE doc_id % 10 IN (0, 3) OR doc_id % 7 = 0"""


@query(CHANGED)
def hash_diff(spark, sf):
    return J.changes(snapshot(spark, sf, False), snapshot(spark, sf, True))


@query(f"SELECT file_path FROM ({CHANGED}) WHERE status = 'D'")
def deleted_files(spark, sf):
    return J.changes(snapshot(spark, sf, False), snapshot(spark, sf, True)).filter("status = 'D'").select("file_path")


@query("SELECT count(DISTINCT sha256(text)) AS n, count(*) AS total FROM documents")
def content_dedupe(spark, sf):
    d = table(spark, sf, "documents").select(T.content_hash(F.col("text"), full=True).alias("hash"))
    none = d.limit(0)
    return J.unseen(d, none).agg(F.count("*").alias("n")).withColumn("total", F.lit(d.count()))


@query("SELECT 'd/' || doc_id AS file_path, (CASE WHEN doc_id % 7 = 0 THEN length(text) + 1 ELSE length(text) END)::INT AS n FROM documents WHERE doc_id % 10 <> 0")
def incremental_upsert(spark, sf):
    """A versioned table after a rebuild and an incremental job, run twice: it equals the later snapshot."""
    store = J.Versioned(spark, shared_path(spark, "store"))
    chunk = lambda files: files.select("file_path", F.length("content").alias("n"))
    states = {"a": snapshot(spark, sf, False), "b": snapshot(spark, sf, True)}
    shot = lambda repo, sha: states[sha].select("file_path", "content")
    diff = lambda repo, a, b: J.changes(states[a], states[b]).select(F.col("file_path").alias("path"), "status")
    J.reindex(store, shot, chunk, {"repo_name": "r", "before_sha": J.NULL_SHA, "after_sha": "a"}, diff)
    for _ in range(2):
        J.reindex(store, shot, chunk, {"repo_name": "r", "before_sha": "a", "after_sha": "b"}, diff)
    return store.read().select(F.regexp_replace("file_path", "^codebase:r/", "").alias("file_path"), "n")


def pushes(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.concat(F.lit("repo"), (F.col("user_id") % 50).cast("string")).alias("repo_name"), F.concat(F.lit("url"), F.col("event_id").cast("string")).alias("clone_url"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("before_sha"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("after_sha"), F.lit("refs/heads/main").alias("ref"), F.col("ts").cast("timestamp").alias("created_at"))


COALESCED = """SELECT 'repo' || (user_id % 50) AS repo_name, arg_max('url' || event_id, (ts, 'a' || event_id, 'b' || event_id)) AS clone_url, arg_min('b' || event_id, (ts, 'b' || event_id, 'a' || event_id)) AS before_sha, arg_max('a' || event_id, (ts, 'a' || event_id, 'b' || event_id)) AS after_sha FROM events GROUP BY 1"""


@query(COALESCED)
def queue_coalesce(spark, sf):
    p = pushes(spark, sf)
    return J.coalesced(p.withColumn("status", F.lit("pending")).limit(0), p).select("repo_name", "clone_url", "before_sha", "after_sha")


@query(COALESCED)
def queue_stream(spark, sf):
    """The same by a stream of files into the queue table."""
    src = shared_path(spark, "pushes")
    p = pushes(spark, sf)
    p.repartition(4, "repo_name").sortWithinPartitions("created_at").write.parquet(src)
    queue = J.Versioned(spark, shared_path(spark, "queue"))
    stream = spark.readStream.schema(p.schema).parquet(src)
    J.run_queue(stream, queue, shared_path(spark, "checkpoint")).awaitTermination()
    return queue.read().select("repo_name", "clone_url", "before_sha", "after_sha")


@query("""WITH e AS (SELECT ts, event_id, (event_id % 97) * 20.0 AS ms, event_type FROM events), l AS (SELECT max(ts) AS m FROM events),
r AS (SELECT ms FROM e, l WHERE event_type <> 'error' AND ts >= m - INTERVAL 24 HOUR), a AS (SELECT list_sort(list(ms)) AS v, count(*) AS jobs, avg(ms) AS avg_ms, sum((ms > 1000)::INT) AS slow FROM r)
SELECT jobs, round(avg_ms, 3) AS avg_ms, round(v[least(floor(0.95 * len(v)), len(v) - 1)::INT + 1], 3) AS p95_ms, (SELECT count(*) FROM e WHERE event_type = 'error') AS queue_depth, slow::BIGINT AS slow FROM a""")
def queue_health_p95(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    done = F.col("ts").cast("timestamp")
    jobs = e.select(F.when(F.col("event_type") == "error", "pending").otherwise("done").alias("status"), done.alias("completed_at"), F.timestamp_micros(F.unix_micros(done) - (F.col("event_id") % 97) * 20_000).alias("created_at"))
    got = J.health(jobs, F.lit(last), "24 hours")
    return got.select("jobs", F.round("avg_ms", 3).alias("avg_ms"), F.round("p95_ms", 3).alias("p95_ms"), "queue_depth", "slow")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf):
    return J.tumbling(table(spark, sf, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE) IS NOT TRUE AS new FROM events),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark, sf):
    return J.sessions(table(spark, sf, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT 'r' || n_nationkey AS repo_name, CASE WHEN n_nationkey % 3 = 0 THEN 's' || n_nationkey ELSE repeat('0', 40) END AS before_sha FROM nation WHERE n_nationkey % 6 <> 0")
def poll_changes(spark, sf):
    n = table(spark, sf, "nation")
    name = F.concat(F.lit("r"), F.col("n_nationkey").cast("string"))
    remote = n.select(name.alias("repo_name"), F.lit("u").alias("clone_url"), F.concat(F.when(F.col("n_nationkey") % 6 == 0, "s").otherwise("t"), F.col("n_nationkey").cast("string")).alias("remote_sha"))
    done = n.filter("n_nationkey % 3 = 0").select(name.alias("repo_name"), F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("after_sha"), F.lit("done").alias("status"), F.lit(1).alias("completed_at"))
    return J.polled(remote, done).select("repo_name", "before_sha")


@query("""WITH v AS (SELECT vec_id, label FROM embeddings), c AS (SELECT label AS category, count(*) AS queries, round(avg(CASE WHEN vec_id % 2 = 0 THEN 1.0 ELSE 0.5 END), 3) AS r5 FROM v GROUP BY 1)
SELECT category::VARCHAR AS category, queries, r5 FROM c UNION ALL SELECT 'overall', sum(queries)::BIGINT, round(sum(r5 * queries) / sum(queries), 3) FROM c""")
def recall_by_category(spark, sf):
    e = table(spark, sf, "embeddings")
    q = F.col("vec_id").cast("string")
    relevant = e.select(q.alias("query_id"), F.col("label").cast("string").alias("category"), F.when(F.col("vec_id") % 2 == 0, F.array(q)).otherwise(F.array(q, F.lit("none"))).alias("ids"))
    return V.recall(e.select(q.alias("query_id"), q.alias("id"), F.lit(1).alias("rank")), relevant, (5,))
