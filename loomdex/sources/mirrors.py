"""Bare mirrors of git repositories in a folder that driver and executors share: the driver lists, executors read blobs."""

from __future__ import annotations

import os
import shutil
import subprocess
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.streaming.jobs import diff_rows


def git(*args: str, cwd: str | None = None, seconds: int = 300) -> str:
    got = subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True, timeout=seconds)
    if got.returncode:
        raise RuntimeError(f"git {args[0]} failed: {got.stderr.strip()[:500]}")
    return got.stdout


class Mirrors:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, repo: str) -> str:
        if not repo or repo.startswith(".") or "/" in repo:
            raise ValueError("not a repository's name")
        return f"{self.root}/{repo}.git"

    def ensure(self, repo: str, url: str) -> str:
        """The mirror, fetched anew or cloned."""
        path = self.path(repo)
        if os.path.isdir(path):
            git("fetch", "origin", "+refs/heads/*:refs/heads/*", cwd=path)
        else:
            os.makedirs(self.root, exist_ok=True)
            git("clone", "--bare", "--", url, path)
        os.utime(f"{path}/HEAD")
        return path

    def revision(self, repo: str, ref: str = "HEAD") -> str:
        return git("rev-parse", "--verify", "--end-of-options", ref, cwd=self.path(repo)).strip()

    def tree(self, repo: str, sha: str) -> DataFrame:
        """(file_path, blob, size) of all files at a revision."""
        lines = [x.split("\t", 1) for x in git("ls-tree", "-r", "-z", "-l", sha, cwd=self.path(repo)).split("\0") if x]
        rows = [(name, *meta.split()[2:4]) for meta, name in lines if meta.split()[1] == "blob"]
        return self.spark.createDataFrame(rows, "file_path string, blob string, size string").withColumn("size", F.col("size").cast("long"))

    def snapshot(self, repo: str, sha: str, most: int = 20 << 20) -> DataFrame:
        """(file_path, content) of all text files at a revision; executors read the blobs, one process a task."""
        path = self.path(repo)

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with subprocess.Popen(["git", "cat-file", "--batch"], cwd=path, stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
                for batch in batches:
                    out = []
                    for blob in batch["blob"]:
                        p.stdin.write(f"{blob}\n".encode())
                        p.stdin.flush()
                        size = int(p.stdout.readline().split()[2])
                        data = p.stdout.read(size + 1)[:size]
                        out.append(None if b"\0" in data[:8000] else data.decode("utf-8", "replace"))
                    yield pd.DataFrame({"file_path": batch["file_path"], "content": out}).dropna()
                p.stdin.close()

        rows = self.tree(repo, sha).filter(F.col("size") <= most).select("file_path", "blob")
        return rows.repartition(F.col("blob")).mapInPandas(read, "file_path string, content string")

    def changed(self, repo: str, before: str, after: str) -> DataFrame:
        """(status, path) between two revisions."""
        lines = git("diff", "--name-status", "-M", before, after, cwd=self.path(repo)).splitlines()
        return diff_rows(self.spark.createDataFrame([(x,) for x in lines], "line string"))

    def evict(self, days: int = 30) -> list[str]:
        """Drops mirrors that were not fetched for so long; returns their names."""
        gone = []
        for name in sorted(os.listdir(self.root)) if os.path.isdir(self.root) else []:
            head = f"{self.root}/{name}/HEAD"
            if name.endswith(".git") and os.path.exists(head) and os.stat(head).st_mtime < time.time() - days * 86400:
                shutil.rmtree(f"{self.root}/{name}")
                gone.append(name[:-4])
        return gone
