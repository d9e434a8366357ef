import hashlib
import hmac
import json
import os

import pytest
from pyspark.sql import functions as F

from loomdex.runtime import shared_path
from loomdex.sources import scan
from loomdex.streaming import jobs as J


def test_changes_and_upserts(spark):
    table = lambda rows: spark.createDataFrame(rows, "file_path string, hash string")
    got = {r["file_path"]: r["status"] for r in J.changes(table([("a", "1"), ("b", "1"), ("c", "1")]), table([("a", "1"), ("b", "2"), ("d", "1")])).collect()}
    assert got == {"b": "M", "c": "D", "d": "A"}
    lines = spark.createDataFrame([("M\tx.py",), ("R100\told.py\tnew.py",), ("D\ty.py",), ("",)], "line string")
    assert {tuple(r) for r in J.diff_rows(lines).collect()} == {("M", "x.py"), ("D", "old.py"), ("A", "new.py"), ("D", "y.py")}
    files = lambda rows: spark.createDataFrame(rows, "file_path string, content_hash string, summary string")
    got = {r["file_path"]: (r["content_hash"], r["summary"]) for r in J.upsert_files(files([("a", "1", "keep"), ("b", "1", None)]), files([("a", "2", None), ("c", "3", "s")])).collect()}
    assert got == {"a": ("2", "keep"), "b": ("1", None), "c": ("3", "s")}
    chunks = table([("memory/a.md", "1"), ("conversations/p/x.jsonl", "2"), ("memory/b.md", "3")])
    assert {r["file_path"] for r in J.prune_curated(chunks, table([("memory/b.md", "3")])).collect()} == {"conversations/p/x.jsonl", "memory/b.md"}
    rows, added = J.with_cache(spark.createDataFrame([("h1", "a"), ("h1", "a"), ("h2", "bb")], "hash string, content string"), spark.createDataFrame([("h2", 99)], "hash string, embedding int"), F.length)
    assert sorted(r["embedding"] for r in rows.collect()) == [1, 1, 99] and added.count() == 1


def test_versions(spark):
    store = J.Versioned(spark, shared_path(spark, "t"))
    assert store.read() is None
    store.write(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"))
    store.upsert(spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int"), "k")
    assert {tuple(r) for r in store.read().collect()} == {("a", 1), ("b", 2), ("c", 2)}
    store.upsert(spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int"), "k")
    assert store.version() == 3 and store.backups(2) == [2, 3] and store.read().count() == 3


def test_writers_claim_versions(spark):
    rows = lambda n: spark.createDataFrame([("a", n)], "k string, v int")
    store = J.Versioned(spark, shared_path(spark, "t"))
    assert store.write(rows(1)) == 1 and store.write(rows(2), base=1) == 2
    with pytest.raises(J.Conflict):
        store.write(rows(3), base=1)  # made for version 1, which another writer has moved on from
    store.folder.put("claims/3", "x")  # a writer that is at work
    with pytest.raises(J.Conflict):
        store.write(rows(4))
    store.stale = -1.0  # or has died
    rows(9).write.parquet(f"{store.root}/v3")
    assert store.write(rows(4)) == 3 and store.read().first()["v"] == 4
    lock = J.FileLock(spark, store.root)
    with lock:
        assert not J.FileLock(spark, store.root).acquire() and J.FileLock(spark, store.root, stale=-1.0).acquire()
    assert lock.acquire()
    assert spark.read.parquet(store.backup(shared_path(spark, "backup"), "2025-01-01")).first()["v"] == 4


def test_buckets_rewrite_only_what_changes(spark):
    store = J.Bucketed(spark, shared_path(spark, "b"), "file_path", buckets=8)
    rows = lambda d: spark.createDataFrame(list(d.items()), "file_path string, v int")
    want = {f"f{i}": i for i in range(40)}
    assert store.read() is None and store.write(rows(want)) == 1
    first = store.places(1)
    store.replace(rows({"f3": 0}).select("file_path"), rows({"f5": 50, "new": 1}), "file_path")
    want = {k: v for k, v in want.items() if k != "f3"} | {"f5": 50, "new": 1}
    assert {r["file_path"]: r["v"] for r in store.read().collect()} == want
    second = store.places(2)
    assert 0 < sum(second[b] != first[b] for b in first) <= 3
    store.upsert(rows({"f7": 70}).withColumn("extra", F.lit("x")), "file_path")
    want["f7"] = 70
    assert {r["file_path"]: r["v"] for r in store.read().collect()} == want and "extra" in store.read().columns
    assert store.backups(1) == [3] and {r["file_path"]: r["v"] for r in store.read().collect()} == want
    store.replace(rows(want).select("file_path"), rows(want).limit(0), "file_path")
    assert store.places(4) == {} and store.read() is None


def test_reindex_and_cascades(spark):
    store = J.Bucketed(spark, shared_path(spark, "chunks"), "file_path", buckets=4)
    trees = {"s1": {"a.py": "1", "b.py": "2"}, "s2": {"a.py": "9", "c.py": "3"}}
    snapshot = lambda repo, sha: spark.createDataFrame(list(trees[sha].items()), "file_path string, content string")
    changed = lambda repo, a, b: spark.createDataFrame([("M", "a.py"), ("D", "b.py"), ("A", "c.py")], "status string, path string")
    job = {"repo_name": "r", "before_sha": J.NULL_SHA, "after_sha": "s1"}
    for repo in ("other", "r"):
        assert J.reindex(store, snapshot, lambda d: d, job | {"repo_name": repo}, changed) == "full"
    assert J.reindex(store, snapshot, lambda d: d, job | {"before_sha": "s1", "after_sha": "s2"}, changed) == "incremental"
    want = {"codebase:other/a.py": "1", "codebase:other/b.py": "2", "codebase:r/a.py": "9", "codebase:r/c.py": "3"}
    assert {r["file_path"]: r["content"] for r in store.read().collect()} == want
    chunks = spark.createDataFrame([("1", "x.md"), ("2", "x.md"), ("3", "y.md")], "id string, file_path string")
    hang = spark.createDataFrame([("1", "e"), ("3", "f")], "chunk_id string, v string")
    got = J.delete_files(chunks.filter("file_path = 'x.md'"), chunks, hang, hang, chunks.select("id"))
    assert {k: [r["chunk_id" if "chunk_id" in v.columns else "id"] for r in v.collect()] for k, v in got.items()} == {"chunks": ["3"], "entities": ["3"], "relations": ["3"], "index": ["3"]}
    files = spark.createDataFrame([("m.md", "h", None)], "file_path string, content_hash string, summary string")
    assert J.stored_revision(files, "r") is None
    files = J.store_revision(J.store_revision(files, "r", "s1"), "r", "s2")
    assert J.stored_revision(files, "r") == "s2" and files.count() == 2


def test_mirrors(spark, tmp_path):
    from loomdex.sources import mirrors as M

    origin = tmp_path / "origin"
    origin.mkdir()
    run = lambda *a: M.git("-c", "user.name=t", "-c", "user.email=t@example.org", *a, cwd=str(origin))
    run("init", "-q", "-b", "main")
    (origin / "a.py").write_text("x = 1\n")
    (origin / "old.py").write_text("one\ntwo\nthree\n")
    (origin / "b.bin").write_bytes(b"\0\1")
    run("add", ".")
    run("commit", "-qm", "one")
    mirrors = M.Mirrors(spark, str(tmp_path / "mirrors"))
    mirrors.ensure("r", str(origin))
    first = mirrors.revision("r", "main")
    (origin / "old.py").rename(origin / "new.py")
    (origin / "a.py").write_text("x = 2 é\n")
    run("add", "-A")
    run("commit", "-qm", "two")
    mirrors.ensure("r", str(origin))
    second = mirrors.revision("r", "main")
    assert {r["file_path"]: r["content"] for r in mirrors.snapshot("r", first).collect()} == {"a.py": "x = 1\n", "old.py": "one\ntwo\nthree\n"}
    assert {tuple(r) for r in mirrors.changed("r", first, second).collect()} == {("M", "a.py"), ("D", "old.py"), ("A", "new.py")}
    assert {r["file_path"] for r in mirrors.tree("r", second).collect()} == {"a.py", "b.bin", "new.py"}
    with pytest.raises(ValueError):
        mirrors.path("../x")
    assert mirrors.evict() == []
    os.utime(f"{mirrors.path('r')}/HEAD", (0, 0))
    assert mirrors.evict() == ["r"] and not os.path.exists(mirrors.path("r"))


def push(repo, before, after, ref="refs/heads/main"):
    return json.dumps({"ref": ref, "before": before, "after": after, "repository": {"name": repo, "clone_url": "u"}})


def test_push_queue(spark):
    sign = lambda b: "sha256=" + hmac.new(b"key", b.encode(), hashlib.sha256).hexdigest()
    bodies = [push("r", "a", "b"), push("r", "b", "c"), push("s", "x", "y", "refs/heads/dev"), push("t", "m", "n")]
    rows = [(b, sign(b), "push", f"2025-01-01 00:00:0{i}") for i, b in enumerate(bodies)] + [(push("bad", "1", "2"), "sha256=0", "push", "2025-01-01 00:00:09"), ("{}", sign("{}"), "ping", "2025-01-01 00:00:09")]
    events = J.push_events(spark.createDataFrame(rows, "body string, signature string, event string, received string").withColumn("received", F.to_timestamp("received")), "key")
    pending = J.coalesced(events.withColumn("status", F.lit("pending")).limit(0), events)
    assert {(r["repo_name"], r["before_sha"], r["after_sha"]) for r in pending.collect()} == {("r", "a", "c"), ("t", "m", "n")}
    assert J.oldest_pending(pending).first()["repo_name"] == "r"
    src, done = shared_path(spark, "in"), []
    events.write.parquet(src)
    queue = J.Versioned(spark, shared_path(spark, "queue"))

    def work(job):
        state = queue.read().filter(F.col("repo_name") == job["repo_name"]).first()
        done.append((job["repo_name"], state["status"], state["attempts"]))
        if job["repo_name"] == "r":
            raise ValueError("no such revision")
        return {"diff": 1.5}

    J.run_queue(spark.readStream.schema(events.schema).parquet(src), queue, shared_path(spark, "cp"), work=work, retries=1).awaitTermination()
    assert done == [("r", "processing", 1), ("r", "processing", 2), ("t", "processing", 1)]
    got = {r["repo_name"]: (r["status"], r["error"], r["timing"]) for r in queue.read().collect()}
    assert got == {"r": ("failed", "ValueError: no such revision", None), "t": ("done", None, {"diff": 1.5})}


def test_health(spark):
    rows = [("done", 100.0 - d, 100.0) for d in (0.1, 0.2, 0.3, 0.4, 0.5)] + [("pending", 99.0, None)] * 3 + [("done", -8000.0, -7200.0)]
    jobs = spark.createDataFrame(rows, "status string, a double, b double").select("status", F.timestamp_micros((F.col("a") * 1e6).cast("long")).alias("created_at"), F.timestamp_micros((F.col("b") * 1e6).cast("long")).alias("completed_at"))
    got = J.health(jobs, F.timestamp_seconds(F.lit(200))).first()
    assert got["jobs"] == 5 and abs(got["avg_ms"] - 300) < 5 and abs(got["p95_ms"] - 500) < 1 and got["queue_depth"] == 3
    empty = J.health(jobs.limit(0), F.timestamp_seconds(F.lit(200))).first()
    assert (empty["jobs"], empty["avg_ms"], empty["p95_ms"]) == (0, 0.0, 0.0)
    timing = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(3.0))
    assert tuple(spark.range(1).select(J.slowest_stage(timing), J.total_time(timing)).first()) == ("b", 4.0)


def test_percentile_equals_sorting(spark):
    import random

    rng = random.Random(2)
    for n in (1, 2, 19, 20, 21, 40, 100, 3000):
        spent = [rng.choice([rng.random(), 0.25]) for _ in range(n)]
        jobs = spark.createDataFrame([("done", 100.0 - s, 100.0) for s in spent], "status string, a double, b double").select("status", F.timestamp_micros((F.col("a") * 1e6).cast("long")).alias("created_at"), F.timestamp_micros((F.col("b") * 1e6).cast("long")).alias("completed_at"))
        assert abs(J.health(jobs, F.timestamp_seconds(F.lit(200))).first()["p95_ms"] - 1000 * sorted(spent)[min(int(0.95 * n), n - 1)]) < 0.01


def test_short_exchanges_and_scored_windows(spark, tmp_path):
    from loomdex.operators import evaluate

    record = lambda kind, content: json.dumps({"type": kind, "message": {"content": content}})
    (tmp_path / "p").mkdir()
    (tmp_path / "p/s.jsonl").write_text("\n".join([record("assistant", "too early"), record("user", " one "), record("assistant", ""), record("assistant", [{"type": "text", "text": "first"}, {"type": "tool_use", "name": "X"}, {"type": "text", "text": "answer"}]), record("assistant", "second"), record("user", "two"), record("user", "x" * 900), record("assistant", "y" * 900)]))
    got = scan.short_exchanges(scan.records(scan.conversation_files(spark, str(tmp_path)))).orderBy("exchange").collect()
    assert [(r["user"], r["assistant"]) for r in got] == [("one", "first answer"), ("two", ""), ("x" * 500, "y" * 500)]
    rows = spark.createDataFrame([(1, i, f"user {i}", "") for i in range(1, 21)] + [(2, i, "u", "a") for i in range(1, 3)], "conv_id long, exchange long, user string, assistant string")
    marks = evaluate.scored_window(rows, lambda w: [9.0, 2.0, 0.5, -1.0])
    seen = {r["boundary"]: (r["score"], r["label"], r["preview"]) for r in marks.collect()}
    assert len(seen) == 15 and seen[0] == (3.0, "strong", "user 2") and seen[1] == (2.0, "moderate", "user 3") and seen[2] == (0.5, "no break", "user 4") and seen[14][0] == 0.0
    assert tuple(evaluate.score_summary(marks).first()) == (1, 0.37, 1, 1, 1, 12)


def test_scans(spark, tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put("MEMORY.md", "# A")
    put("memory/2026-02-05.md", "x")
    put("memory/deep/n.md", "y")
    put("other/z.md", "no")
    put("memory/k.txt", "no")
    root = str(tmp_path)
    assert {r["file_path"] for r in scan.curated(spark, root).collect()} == {"MEMORY.md", "memory/2026-02-05.md", "memory/deep/n.md"}
    record = lambda kind, content, **k: json.dumps({"type": kind, "sessionId": "abc-123", "cwd": "/home/test", "timestamp": "2025-01-01T00:00:00Z", "message": {"content": content}} | k)
    put("c/proj/s1.jsonl", "\n".join([record("user", "Fix the bug"), "{broken", record("assistant", [{"type": "thinking", "text": "hm"}, {"type": "text", "text": "I fixed it."}, {"type": "tool_use", "name": "Edit"}]), record("user", "thanks")]))
    put("c/proj/agent-1.jsonl", "{}")
    put("c/proj/empty.jsonl", "")
    talks = scan.conversation_files(spark, root + "/c")
    assert [r["file_path"] for r in talks.select("file_path").collect()] == ["proj/s1.jsonl"]
    got = scan.exchanges(scan.records(talks)).orderBy("exchange").collect()
    assert [(r["user"], r["assistant"], r["tools"], r["session"], r["cwd"]) for r in got] == [("Fix the bug", "I fixed it.", ["Edit"], "abc-123", "/home/test"), ("thanks", "", [], "abc-123", "/home/test")]
    assert "[User]: Fix the bug\n\n[Assistant]: I fixed it." in scan.rendered(scan.exchanges(scan.records(talks))).first()["content"]
    put("src/a/main.py", "x = 1")
    put("src/node_modules/b.js", "no")
    put("src/gen/c.py", "x")
    assert {r["file_path"] for r in scan.source_files(spark, root + "/src", exclude=["gen/*"]).collect()} == {"a/main.py"}
    put("src/pom.xml", "<p/>")
    assert {r["file_path"] for r in scan.build_files(spark, root + "/src").collect()} == {"pom.xml"}
    put("s/x-summary.txt", " done \n")
    put("s/y-summary.txt", "  ")
    assert {r["session"]: r["summary"] for r in scan.summaries(spark, root + "/s").collect()} == {"x": "done", "y": None}
    put("ref/d.html", "<h1>Hi</h1><script>no</script>")
    assert scan.reference_files(spark, root + "/ref").first()["content"] == "Hi"
