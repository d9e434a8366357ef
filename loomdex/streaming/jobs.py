"""Change detection, versioned tables, the push-driven job stream and its health."""

from __future__ import annotations

import hashlib
import hmac
import json
import time
import uuid
from collections.abc import Callable

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NULL_SHA = "0" * 40


# ---- tables in versions -------------------------------------------------------------------------


def replace_rows(existing: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of the new keys take the place of all old ones: anti-join and union."""
    keys = [key] if isinstance(key, str) else key
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_keys(rows: DataFrame, gone: DataFrame, key: str | list[str]) -> DataFrame:
    return rows.join(gone, key, "left_anti")


def delete_prefix(rows: DataFrame, prefix: str, column: str = "file_path") -> DataFrame:
    return rows.filter(~F.col(column).startswith(prefix))


def delete_files(paths: DataFrame, chunks: DataFrame, entities: DataFrame | None = None, relations: DataFrame | None = None, index: DataFrame | None = None) -> dict[str, DataFrame]:
    """All that hangs on files' chunks goes with them: chunks, then entities and relations by chunk_id and index rows by id."""
    gone = chunks.join(paths.select("file_path").distinct(), "file_path", "left_semi").select("id")
    out = {"chunks": chunks.join(paths.select("file_path").distinct(), "file_path", "left_anti")}
    for name, rows, key in (("entities", entities, "chunk_id"), ("relations", relations, "chunk_id"), ("index", index, "id")):
        if rows is not None:
            out[name] = rows.join(gone.select(F.col("id").alias(key)), key, "left_anti")
    return out


REVISION = "/.git-sha"


def stored_revision(files: DataFrame, repo: str) -> str | None:
    """The revision that a repository was last indexed at, kept as the hash of a row `codebase/<repo>/.git-sha` of the files table."""
    row = files.filter(F.col("file_path") == f"codebase/{repo}{REVISION}").select("content_hash").first()
    return row[0] if row else None


def store_revision(files: DataFrame, repo: str, sha: str) -> DataFrame:
    path = f"codebase/{repo}{REVISION}"
    row = files.sparkSession.range(1).select(F.lit(path).alias("file_path"), F.lit(sha).alias("content_hash"))
    return files.filter(F.col("file_path") != path).unionByName(row, allowMissingColumns=True)


def upsert_files(existing: DataFrame, new: DataFrame) -> DataFrame:
    """File rows by path; a summary that the new row lacks is kept."""
    old, x = existing.alias("o"), new.alias("n")
    pick = lambda c: F.when(F.col("n.file_path").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    both = old.join(x, F.col("o.file_path") == F.col("n.file_path"), "full_outer")
    return both.select(*(F.coalesce("n.summary", "o.summary").alias("summary") if c == "summary" else pick(c) for c in existing.columns))


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row a key: the last by a column, ties by all columns."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(by, *(c for c in rest if c != by))).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*rows.columns)


class Conflict(RuntimeError):
    """Another writer has taken the version this one was made for; read again and retry."""


class Folder:
    """A folder of any Hadoop file system: markers, small files, exclusive creation."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.root, self._spark = root, spark
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.at(name))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self.at(name))] if self.exists(name) else []

    def age(self, name: str) -> float:
        """Seconds since a file was written."""
        return time.time() - self._fs.getFileStatus(self.at(name)).getModificationTime() / 1000

    def put(self, name: str, text: str, overwrite: bool = True) -> None:
        out = self._fs.create(self.at(name), overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def get(self, name: str) -> str:
        reader = self._spark.sparkContext._jvm.java.io.InputStreamReader(self._fs.open(self.at(name)), "UTF-8")
        lines = self._spark.sparkContext._jvm.java.io.BufferedReader(reader)
        out = []
        while (line := lines.readLine()) is not None:
            out.append(line)
        lines.close()
        return "\n".join(out)

    def drop(self, name: str) -> None:
        self._fs.delete(self.at(name), True)


class FileLock:
    """One holder at a time: a file that is created exclusively. A lock older than `stale` seconds is broken."""

    def __init__(self, spark: SparkSession, root: str, name: str = "lock", stale: float = 300.0):
        self.folder, self.name, self.stale = Folder(spark, root), name, stale

    def acquire(self) -> bool:
        for _ in range(2):
            try:
                self.folder.put(self.name, uuid.uuid4().hex, overwrite=False)
                return True
            except Py4JJavaError:
                if not self.folder.exists(self.name):
                    continue
                if self.folder.age(self.name) <= self.stale:
                    return False
                self.folder.drop(self.name)
        return False

    def release(self) -> None:
        self.folder.drop(self.name)

    def __enter__(self) -> FileLock:
        if not self.acquire():
            raise Conflict(f"{self.name} is held")
        return self

    def __exit__(self, *_) -> None:
        self.release()


class Versioned:
    """A table as numbered folders and a marker for each; a write never touches what is being read. A version's number is claimed by
    exclusive creation, so of two writers from one base the second gets a Conflict; a claim left by a writer that
    died goes after `stale` seconds."""

    def __init__(self, spark: SparkSession, root: str, stale: float = 300.0):
        self.spark, self.root, self.stale = spark, root, stale
        self.folder = Folder(spark, root)

    def version(self) -> int | None:
        """The highest version that is complete."""
        return max(map(int, self.folder.names("current")), default=None)

    def read(self) -> DataFrame | None:
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.root}/v{v}")

    def _claim(self, v: int) -> FileLock:
        claim = FileLock(self.spark, self.root, f"claims/{v}", self.stale)
        if self.folder.exists(f"current/{v}") or not claim.acquire():
            raise Conflict(f"version {v} is taken")
        self.folder.drop(f"v{v}")  # what a dead writer left
        return claim

    def write(self, rows: DataFrame, partition_by: list[str] | None = None, base: int | None = None) -> int:
        """The whole table anew, as the version after `base` (by default the current one)."""
        v = (self.version() if base is None else base) or 0
        self._claim(v + 1)
        out = rows.write.mode("errorifexists")
        (out.partitionBy(*partition_by) if partition_by else out).parquet(f"{self.root}/v{v + 1}")
        self.folder.put(f"current/{v + 1}", "")
        return v + 1

    def replace(self, gone: DataFrame, fresh: DataFrame, key: str) -> int:
        """Rows whose key is in `gone` go, `fresh` rows come; one version."""
        base, old = self.version(), self.read()
        return self.write(fresh if old is None else delete_keys(old, gone.select(key).distinct(), key).unionByName(fresh, allowMissingColumns=True), base=base or 0)

    def upsert(self, new: DataFrame, key: str | list[str]) -> int:
        base, old = self.version(), self.read()
        return self.write(new if old is None else replace_rows(old, new, key), base=base or 0)

    def backups(self, keep: int = 3) -> list[int]:
        """Drops versions older than the last `keep`; returns those that stay."""
        v = self.version() or 0
        for n in range(1, v - keep + 1):
            for part in (f"current/{n}", f"claims/{n}", f"v{n}"):
                self.folder.drop(part)
        return list(range(max(1, v - keep + 1), v + 1))

    def backup(self, to: str, as_of: str) -> str:
        """A dated copy of the current version, beside the numbered ones."""
        rows = self.read()
        path = f"{to}/{as_of}"
        if rows is not None:
            rows.write.mode("errorifexists").parquet(path)
        return path


class Bucketed(Versioned):
    """A versioned table in buckets of its key's hash: a change rewrites the buckets it touches, and a version is a small list of the
    folder that holds each bucket. Folders that no kept version lists are dropped by `backups`."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64, stale: float = 300.0):
        super().__init__(spark, root, stale)
        self.key, self.buckets = key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def places(self, v: int | None) -> dict[str, str]:
        return json.loads(self.folder.get(f"current/{v}")) if v else {}

    def _rows(self, places: dict[str, str], only: set[int] | None = None) -> DataFrame | None:
        folders = sorted(f"{self.root}/{f}/bucket={b}" for b, f in places.items() if only is None or int(b) in only)
        return self.spark.read.option("mergeSchema", True).parquet(*folders) if folders else None

    def read(self) -> DataFrame | None:
        return self._rows(self.places(self.version()))

    def _commit(self, v: int, rows: DataFrame, kept: dict[str, str]) -> int:
        self._claim(v)
        rows.withColumn("bucket", self._bucket()).repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.root}/v{v}")
        made = {n.split("=")[1]: f"v{v}" for n in self.folder.names(f"v{v}") if n.startswith("bucket=")}
        self.folder.put(f"current/{v}", json.dumps(kept | made))
        return v

    def write(self, rows: DataFrame, partition_by: list[str] | None = None, base: int | None = None) -> int:
        return self._commit(((self.version() if base is None else base) or 0) + 1, rows, {})

    def replace(self, gone: DataFrame, fresh: DataFrame, key: str) -> int:
        if key != self.key:
            raise ValueError("the table is bucketed by another key")
        base = self.version()
        places = self.places(base)
        keys = gone.select(key).union(fresh.select(key)).distinct()
        touched = {r[0] for r in keys.select(self._bucket()).distinct().collect()}  # at most `buckets` numbers
        old = self._rows(places, touched)
        rows = fresh if old is None else old.join(keys, key, "left_anti").unionByName(fresh, allowMissingColumns=True)
        return self._commit((base or 0) + 1, rows, {b: f for b, f in places.items() if int(b) not in touched})

    def upsert(self, new: DataFrame, key: str | list[str]) -> int:
        return self.replace(new.select(self.key), new, key if isinstance(key, str) else key[0])

    def backups(self, keep: int = 3) -> list[int]:
        v = self.version() or 0
        kept = list(range(max(1, v - keep + 1), v + 1))
        used = {f for n in kept if self.folder.exists(f"current/{n}") for f in self.places(n).values()}
        for n in range(1, v - keep + 1):
            self.folder.drop(f"current/{n}")
            self.folder.drop(f"claims/{n}")
        for n in range(1, v + 1):
            if f"v{n}" not in used:
                self.folder.drop(f"v{n}")
        return kept


# ---- what has changed ---------------------------------------------------------------------------


def changes(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """(file_path, status): A new, M of another hash, D gone. One full outer join."""
    s, n = stored.select("file_path", F.col("hash").alias("old")), seen.select("file_path", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").when(F.col("old") != F.col("new"), "M")
    return s.join(n, "file_path", "full_outer").select("file_path", status.alias("status")).filter("status is not null")


def diff_rows(lines: DataFrame, column: str = "line") -> DataFrame:
    """Name-status lines of a diff to (status, path); a rename is a delete and an add, a copy an add."""
    p = F.split(F.col(column), "\t")
    kind = F.substr(F.get(p, F.lit(0)), F.lit(1), F.lit(1))
    row = lambda s, at: F.struct(F.lit(s).alias("status") if isinstance(s, str) else s.alias("status"), F.get(p, F.lit(at)).alias("path"))
    rows = F.when(kind == "R", F.array(row("D", 1), row("A", 2))).when(kind == "C", F.array(row("A", 2))).otherwise(F.array(row(kind, 1)))
    return lines.filter(F.size(p) > 1).select(F.inline(rows))


def stale_files(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Files that are new, gone or changed after they were indexed: (file_path, why)."""
    s, n = stored.select("file_path", "last_indexed"), seen.select("file_path", "modified")
    why = F.when(F.col("last_indexed").isNull(), "new").when(F.col("modified").isNull(), "gone").when(F.col("modified") > F.col("last_indexed"), "changed")
    return s.join(n, "file_path", "full_outer").select("file_path", why.alias("why")).filter("why is not null")


def unseen(new: DataFrame, known: DataFrame, key: str = "hash") -> DataFrame:
    """One row of each content hash that the index lacks."""
    return new.dropDuplicates([key]).join(known.select(key).distinct(), key, "left_anti")


def prune_curated(chunks: DataFrame, files: DataFrame, path: str = "file_path") -> DataFrame:
    """Curated files that are no longer there go; conversations and code never do."""
    from loomdex.functions.text import source_kind

    gone = chunks.filter(source_kind(F.col(path)) == "curated").select(path).distinct().join(files.select(path), path, "left_anti")
    return chunks.join(gone, path, "left_anti")


def with_cache(rows: DataFrame, cache: DataFrame, compute: Callable[[Column], Column], text: str = "content", key: str = "hash", value: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows with the value, cache rows to add): each missing hash is computed once."""
    missing = rows.select(key, text).dropDuplicates([key]).join(cache.select(key), key, "left_anti")
    added = missing.select(key, compute(F.col(text)).alias(value))
    return rows.join(cache.select(key, value).unionByName(added), key, "left"), added


def evict(cache: DataFrame, as_of: Column, days: int = 30, column: str = "created_at") -> DataFrame:
    return cache.filter(F.col(column) >= as_of - F.expr(f"interval {days} days"))


# ---- push events to jobs ------------------------------------------------------------------------


def signed(body: Column, signature: Column, secret: str) -> Column:
    """Whether `sha256=<hex>` is the body's keyed hash; there is no built-in for it."""

    @F.pandas_udf("boolean")
    def run(b: pd.Series, s: pd.Series) -> pd.Series:
        good = lambda x, y: y is not None and hmac.compare_digest("sha256=" + hmac.new(secret.encode(), (x or "").encode(), hashlib.sha256).hexdigest(), y)
        return pd.Series([good(x, y) for x, y in zip(b, s)], dtype="bool")

    return run(body, signature)


PUSH = "ref string, before string, after string, repository struct<name:string,clone_url:string>"


def push_events(rows: DataFrame, secret: str | None = None) -> DataFrame:
    """rows (body, signature, event, received) to pushes of a main branch; works on a stream as on a batch."""
    good = rows.filter(F.col("event") == "push")
    if secret:
        good = good.filter(signed(F.col("body"), F.col("signature"), secret))
    x = good.select(F.from_json("body", PUSH).alias("p"), "received").filter(F.col("p.ref").isin("refs/heads/main", "refs/heads/master"))
    return x.select(F.col("p.repository.name").alias("repo_name"), F.col("p.repository.clone_url").alias("clone_url"), F.col("p.before").alias("before_sha"), F.col("p.after").alias("after_sha"), F.col("p.ref").alias("ref"), F.col("received").alias("created_at"))


def polled(remote: DataFrame, done: DataFrame) -> DataFrame:
    """Repositories whose remote revision is not the last one done."""
    last = latest(done.filter("status = 'done'").select("repo_name", "after_sha", "completed_at"), ["repo_name"], "completed_at")
    return remote.join(last.select("repo_name", F.col("after_sha").alias("stored")), "repo_name", "left").filter(F.col("remote_sha") != F.coalesce("stored", F.lit(""))).select("repo_name", "clone_url", F.coalesce("stored", F.lit(NULL_SHA)).alias("before_sha"), F.col("remote_sha").alias("after_sha"))


JOB = ["repo_name", "clone_url", "before_sha", "after_sha", "ref", "status", "created_at"]


def coalesced(pending: DataFrame, events: DataFrame) -> DataFrame:
    """One pending job a repository: revision before, ref and time of the first push, revision after and URL of the last. The
    pre-aggregated shape of a queue's upsert; jobs already taken are not among `pending`."""
    every = pending.select(*JOB).unionByName(events.withColumn("status", F.lit("pending")).select(*JOB))
    first, last = F.struct("created_at", "before_sha", "after_sha"), F.struct("created_at", "after_sha", "before_sha")
    got = every.groupBy("repo_name").agg(F.max_by("clone_url", last).alias("clone_url"), F.min_by("before_sha", first).alias("before_sha"), F.max_by("after_sha", last).alias("after_sha"), F.min_by("ref", first).alias("ref"), F.min("created_at").alias("created_at"))
    return got.withColumn("status", F.lit("pending")).select(*JOB)


def oldest_pending(jobs: DataFrame) -> DataFrame:
    return jobs.filter("status = 'pending'").orderBy("created_at", "repo_name").limit(1)


def claimed(jobs: DataFrame, repo: str, at: Column) -> DataFrame:
    """The repository's pending job is being worked on from now, once more than before."""
    own = (F.col("repo_name") == repo) & (F.col("status") == "pending")
    have = lambda c, kind: F.col(c) if c in jobs.columns else F.lit(None).cast(kind)
    return jobs.withColumns({"attempts": F.coalesce(have("attempts", "int"), F.lit(0)) + own.cast("int"), "started_at": F.when(own, at).otherwise(have("started_at", "timestamp")), "status": F.when(own, "processing").otherwise(F.col("status"))})


def claim_oldest(queue: Versioned, at: Column | None = None) -> dict | None:
    """Takes the oldest pending job: its version of the table is claimed exclusively, so of two workers one gets a Conflict and asks again."""
    while True:
        base, jobs = queue.version(), queue.read()
        job = None if jobs is None else oldest_pending(jobs).first()
        if job is None:
            return None
        try:
            queue.write(claimed(jobs, job["repo_name"], F.current_timestamp() if at is None else at), base=base)
            return job.asDict()
        except Conflict:
            if queue.version() == base:
                time.sleep(0.5)  # the other writer hasn't finished


def finished(jobs: DataFrame, repo: str, completed_at: Column, timing: dict[str, float] | None = None, error: str | None = None, retries: int = 0) -> DataFrame:
    """The job done, or failed with an error, and its stages' times. A failed job that was tried at most `retries` times is pending again."""
    own = (F.col("repo_name") == repo) & (F.col("status") == "processing")
    spent = F.create_map(*(x for k, v in (timing or {}).items() for x in (F.lit(k), F.lit(float(v))))) if timing else F.lit(None).cast("map<string,double>")
    ended = F.lit("failed" if error else "done")
    if error and "attempts" in jobs.columns:
        ended = F.when(F.col("attempts") <= retries, "pending").otherwise(ended)
    values = {"status": ended, "completed_at": completed_at, "error": F.lit(error).cast("string"), "timing": spent}
    return jobs.withColumns({c: F.when(own, v).otherwise(F.col(c) if c in jobs.columns else F.lit(None)) for c, v in values.items()})


def slowest_stage(timing: Column) -> Column:
    pairs = F.transform(F.map_entries(timing), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k")))
    return F.array_max(pairs)["k"]


def total_time(timing: Column) -> Column:
    return F.aggregate(F.map_values(timing), F.lit(0.0), lambda a, x: a + x)


def health(jobs: DataFrame, as_of: Column, window: str = "1 hour") -> DataFrame:
    """Of the trailing window: jobs, mean and 95th percentile of latency (the value at min(floor(.95 n), n - 1) of the sorted ones), and
    the depth of the queue. The percentile's place is bracketed by approximate percentiles half a hundredth to each side, and only the
    latencies between those are put in order."""
    recent = (F.col("status") == "done") & (F.col("completed_at") >= as_of - F.expr(f"interval {window}")) & (F.col("completed_at") <= as_of)
    ms = (F.col("completed_at").cast("double") - F.col("created_at").cast("double")) * 1000
    got = jobs.agg(F.count_if(recent).alias("jobs"), F.avg(F.when(recent, ms)).alias("avg_ms"), F.percentile_approx(F.when(recent, ms), [0.945, 0.955], 10_000).alias("around"), F.count_if(F.col("status") == "pending").alias("queue_depth"), F.count_if(recent & (ms > 1000)).alias("slow"))
    done = jobs.filter(recent).select(ms.alias("ms")).crossJoin(F.broadcast(got.select("jobs", "around")))  # one row
    low, high = F.get("around", F.lit(0)), F.get("around", F.lit(1))
    below = done.agg(F.count_if(F.col("ms") < low).alias("below"))
    near = done.filter(F.col("ms").between(low, high)).withColumn("at", F.row_number().over(Window.orderBy("ms")))
    want = F.least(F.floor(0.95 * F.col("jobs")), F.col("jobs") - 1) + 1
    p95 = near.crossJoin(F.broadcast(below)).filter(F.col("at") + F.col("below") == want).agg(F.max("ms").alias("p95"))
    return got.crossJoin(F.broadcast(p95)).select("jobs", F.coalesce("avg_ms", F.lit(0.0)).alias("avg_ms"), F.coalesce("p95", F.lit(0.0)).alias("p95_ms"), "queue_depth", "slow")


def reindex(store: Versioned, snapshot: Callable[[str, str], DataFrame], chunker: Callable[[DataFrame], DataFrame], job: dict, changed: Callable[[str, str, str], DataFrame] | None = None) -> str:
    """A job on a table of chunks: a full rebuild of the repository without a revision before (or a diff), else deletes and
    replacements of the changed files. Running a job again changes nothing. `snapshot(repo, sha)` gives (file_path, content)."""
    repo, prefix = job["repo_name"], f"codebase:{job['repo_name']}/"
    files = snapshot(repo, job["after_sha"]).withColumn("file_path", F.concat(F.lit(prefix), "file_path"))
    old = store.read()
    diff = changed(repo, job["before_sha"], job["after_sha"]) if changed and job["before_sha"] not in (None, "", NULL_SHA) else None
    if diff is None or old is None:
        gone = files.select("file_path").limit(0) if old is None else old.filter(F.col("file_path").startswith(prefix)).select("file_path")
        store.replace(gone, chunker(files), "file_path")
        return "full"
    diff = diff.withColumn("file_path", F.concat(F.lit(prefix), "path")).select("file_path", "status")
    fresh = chunker(files.join(diff.filter("status <> 'D'").select("file_path").distinct(), "file_path", "left_semi"))
    store.replace(diff.select("file_path"), fresh, "file_path")
    return "incremental"


def work_off(queue: Versioned, work: Callable[[dict], dict | None], retries: int = 0) -> int:
    """Jobs oldest first until none is pending; `work` may return its stages' times. One that raises is marked failed, and the next goes on."""
    n = 0
    while (job := claim_oldest(queue)) is not None:
        timing, error = None, None
        try:
            timing = work(job)
        except Exception as e:  # a job's failure is its own
            error = f"{type(e).__name__}: {e}"[:2000]
        queue.write(finished(queue.read(), job["repo_name"], F.current_timestamp(), timing if isinstance(timing, dict) else None, error, retries))
        n += 1
    return n


def run_queue(pushes: DataFrame, queue: Versioned, checkpoint: str, work: Callable[[dict], dict | None] | None = None, once: bool = True, retries: int = 0):
    """A stream of pushes into the queue table, one version a micro-batch, then the jobs oldest first. Batches are known by their
    id, so a batch that is replayed after a failure is the same upsert."""

    def each(batch: DataFrame, batch_id: int) -> None:
        base, old = queue.version(), queue.read()
        pending = batch.sparkSession.createDataFrame([], batch.withColumn("status", F.lit("pending")).select(*JOB).schema) if old is None else old.filter("status = 'pending'").select(*JOB)
        jobs = coalesced(pending, batch)
        rest = None if old is None else old.filter("status <> 'pending'")
        queue.write(jobs if rest is None else rest.unionByName(jobs, allowMissingColumns=True), base=base or 0)
        if work:
            work_off(queue, work, retries)

    out = pushes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="5 seconds")).start()


# ---- event windows ------------------------------------------------------------------------------


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Counts and sums by window and type; the watermark holds for a stream and is void for a batch."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts", user: str = "user_id") -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def best_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
