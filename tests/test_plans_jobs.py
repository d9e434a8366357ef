import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.operators import retrieve as R
from loomdex.plans import jobs as P
from loomdex.runtime import shared_path
from loomdex.streaming import jobs as J


def test_notes(spark, tmp_path):
    root, store = str(tmp_path), J.Versioned(spark, shared_path(spark, "chunks"))
    P.write_note(spark, root, "memory/2025-01-02.md", "# Day\nWe use Slack")
    P.write_note(spark, root, "memory/2025-01-02.md", "more")
    assert (tmp_path / "memory/2025-01-02.md").read_text() == "# Day\nWe use Slack\nmore"
    P.write_note(spark, root, "MEMORY.md", "# A\nx")
    for bad in ("../x.md", "/x.md", "x.txt"):
        with pytest.raises(ValueError):
            P.write_note(spark, root, bad, "")
    assert P.index_curated(spark, root, store) == 1 and P.index_curated(spark, root, store) is None
    P.write_note(spark, root, "MEMORY.md", "# B\ny", append=False)
    (tmp_path / "memory/2025-01-02.md").unlink()
    assert P.index_curated(spark, root, store) == 2
    assert [(r["file_path"], r["title"]) for r in store.read().collect()] == [("MEMORY.md", "B")]


def test_sessions(spark, tmp_path):
    record = lambda kind, text: json.dumps({"type": kind, "sessionId": "s", "timestamp": "2025-03-01T00:00:00Z", "message": {"content": text}})
    (tmp_path / "proj").mkdir()
    (tmp_path / "proj/s1.jsonl").write_text("\n".join([record("user", "Fix Jira bug"), record("assistant", "done"), record("user", "Edit operation feedback: x"), record("assistant", "y"), record("user", "Base directory for this skill: z"), record("assistant", " ")]))
    store = J.Versioned(spark, shared_path(spark, "talks"))
    assert P.index_sessions(spark, str(tmp_path), store) == 1 and P.index_sessions(spark, str(tmp_path), store) is None
    r = store.read().first()
    assert r["file_path"] == "conversations/proj/s1.jsonl" and r["title"] == "proj — Fix Jira bug" and str(r["event_date"]) == "2025-03-01"
    assert r["content"] == "User: Fix Jira bug\n\nAssistant: done"
    found, pairs = P.signals(store.read())
    assert {x["entity_value"] for x in found.collect()} >= {"jira"}
    index = R.postings(store.read())
    assert all(x["ok"] for x in P.doctor(store.read(), index, found).collect())
    assert {x["check"] for x in P.doctor(store.read(), index.limit(0), found).filter("not ok").collect()} == {"missing_from_index"}


def test_code_index(spark):
    files = spark.createDataFrame([("src/app/main.py", "import app.util\nfrom app import util\n\ndef run(x):\n    y = util.helper(x)\n    return y\n"), ("src/app/util.py", "class Base:\n    pass\n\ndef helper(x):\n    z = x\n    return z\n"), ("pyproject.toml", '[project]\ndependencies = ["requests>=2"]')], "file_path string, content string")
    got = P.index_code(files, "demo")
    edges = {(r["source_file"], r["target_file"], r["edge_type"]) for r in got["edges"].collect()}
    assert ("src/app/main.py", "src/app/util.py", "calls") in edges and ("src/app/main.py", "src/app/util.py", "import") in edges
    assert ("pyproject.toml", None, "build_dependency") in edges
    assert {r["name"] for r in got["symbols"].collect()} == {"run", "Base", "helper"}
    assert all(r["file_path"].startswith("codebase:demo/") for r in got["chunks"].collect())


def test_quantization(spark):
    x = np.random.RandomState(2).randn(300, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, [1.0])], "id long, embedding array<double>")
    q = P.quantized(rows, 64)
    assert q.filter("code4 is null").count() == 1 and len(q.filter("id = 1").first()["code4"]) == 32
    recall, fine = P.verify_quantized(rows.filter("id < 300"), queries=3)
    assert fine and recall >= 0.9
    one = P.quantization_params(None, "m", 64, 4, 42, F.current_timestamp(), spark)
    assert P.quantization_params(one, "m", 64, 4, 7, F.current_timestamp(), spark).count() == 1


def test_settings_backfill_and_timer(spark):
    meta = spark.createDataFrame([("model", "a")], "key string, value string")
    assert not P.needs_rebuild(meta, {"model": "a"}) and P.needs_rebuild(meta, {"model": "b"}) and P.needs_rebuild(None, {})
    chunks = spark.createDataFrame([("1", "memory/2025-01-05.md", "Slack", "t", None), ("2", "x.md", "none", "t", None)], "id string, file_path string, content string, title string, event_date string").withColumn("event_date", F.to_date("event_date"))
    dated, found = P.backfill(chunks, None, F.lit("2025-06-01").cast("date"))
    assert {r["id"]: str(r["event_date"]) for r in dated.collect()} == {"1": "2025-01-05", "2": "None"}
    assert P.backfill(dated, found, F.lit("2025-06-01").cast("date"))[1].count() == found.count()
    timer = P.StageTimer()
    assert timer.run("a", lambda: 5) == 5 and timer.summary()["slowest"] == "a"
