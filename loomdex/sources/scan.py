"""Scans: each reads a folder tree by Spark's own readers into typed rows; selection is a filter on path and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex import schema
from loomdex.functions import text as T

MOST_BYTES = 20 << 20
SOURCE_EXTENSIONS = (".py", ".java", ".kt", ".kts", ".ts", ".tsx", ".js", ".jsx", ".sh", ".md")
BUILD_FILES = r"(?:^|/)(?:build\.gradle(?:\.kts)?|settings\.gradle(?:\.kts)?|pom\.xml|package\.json|pyproject\.toml|requirements[^/]*\.txt|[^/]*\.versions\.toml)$"
SKIPPED = r"(?:^|/)(?:node_modules|\.git|build|dist|target|out|__pycache__|\.gradle|\.idea|venv|\.venv)(?:/|$)"


def files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(file_path below the root, modified, size, data); selecting no data reads none."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    tail = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), r"^\Q" + "/" + root.split("://")[-1].strip("/").removeprefix("file:").strip("/") + r"\E/*", "")
    return rows.select(tail.alias("file_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.col("content").alias("data"))


def as_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("content", F.decode("data", "UTF-8")).drop("data")


def curated(spark: SparkSession, root: str) -> DataFrame:
    """MEMORY.md and memory/**/*.md."""
    return as_text(files(spark, root, "*.md").filter((F.col("file_path") == "MEMORY.md") | F.col("file_path").startswith("memory/")))


def conversation_files(spark: SparkSession, root: str) -> DataFrame:
    """<project>/*.jsonl but for agent runs, above 0 and up to 20 MB."""
    name = F.element_at(F.split("file_path", "/"), -1)
    return files(spark, root, "*.jsonl").filter((F.size(F.split("file_path", "/")) == 2) & ~name.startswith("agent-") & F.col("size").between(1, MOST_BYTES))


def archive_files(spark: SparkSession, root: str) -> DataFrame:
    """A flat folder of project_uuid[_date].jsonl, with the path each has in the index."""
    return files(spark, root, "*.jsonl").withColumn("index_path", T.archive_path(F.col("file_path"))).filter(F.col("index_path").isNotNull())


def source_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = SOURCE_EXTENSIONS, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    rows = files(spark, root).filter(T.indexable(F.col("file_path"), extensions) & ~F.col("file_path").rlike(SKIPPED))
    for globs, keep in ((include, True), (exclude, False)):
        if globs:
            hit = F.exists(F.array(*map(F.lit, map(glob_pattern, globs))), lambda g: F.regexp_like(F.col("file_path"), g))
            rows = rows.filter(hit if keep else ~hit)
    return as_text(rows)


def glob_pattern(glob: str) -> str:
    """A shell pattern as a whole-string expression; * also crosses folders."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() and c != "_" else c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


# Names of build files whose dependencies are those of a whole repository.
REPO_BUILD_FILES = ("build.gradle", "build.gradle.kts", "pom.xml", "package.json", "requirements.txt", "pyproject.toml")


def build_files(spark: SparkSession, root: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """Build files by pattern, or by exact name."""
    fits = F.col("file_path").rlike(BUILD_FILES) if names is None else F.element_at(F.split("file_path", "/"), -1).isin(*names)
    return as_text(files(spark, root).filter(fits & ~F.col("file_path").rlike(SKIPPED)))


def reference_files(spark: SparkSession, root: str) -> DataFrame:
    """Documentation; HTML becomes text."""
    rows = as_text(files(spark, root).filter(F.col("file_path").rlike(r"\.(?:md|txt|rst|html?)$")))
    return rows.withColumn("content", F.when(F.col("file_path").rlike(r"\.html?$"), T.html_to_text(F.col("content"))).otherwise(F.col("content")))


def summaries(spark: SparkSession, root: str) -> DataFrame:
    """<session>-summary.txt, trimmed; empty ones are null."""
    rows = as_text(files(spark, root, "*-summary.txt"))
    return rows.select(F.regexp_extract("file_path", r"([^/]+)-summary\.txt$", 1).alias("session"), F.nullif(T.strip(F.col("content")), F.lit("")).alias("summary"))


def eligible_repositories(listed: DataFrame, indexed: DataFrame, least: int, most: int, exclude: list[str]) -> DataFrame:
    """(repo, file_path) to repositories of a fitting size that are neither excluded nor indexed."""
    counts = listed.groupBy("repo").agg(F.count("*").alias("n_files")).filter(F.col("n_files").between(least, most))
    counts = counts.filter(~F.col("repo").isin(*exclude)) if exclude else counts
    return counts.join(indexed.select("repo"), "repo", "left_anti")


# ---- conversation records -----------------------------------------------------------------------


def records(rows: DataFrame) -> DataFrame:
    """(file_path, data) of JSONL files to records with their line number; malformed lines are dropped."""
    lines = as_text(rows).select("file_path", F.posexplode(F.split("content", "\n")).alias("line", "json"))
    parsed = lines.filter(T.strip(F.col("json")) != "").withColumn("r", F.from_json("json", "type string, sessionId string, cwd string, timestamp string, message struct<role:string,content:string>"))
    return parsed.filter(F.col("r").isNotNull() & F.col("r.type").isNotNull()).select("file_path", (F.col("line") + 1).alias("line"), F.col("r.type").alias("type"), F.col("r.sessionId").alias("session"), F.col("r.cwd").alias("cwd"), F.col("r.timestamp").alias("timestamp"), F.col("r.message.content").alias("content"))


def message_text(content: Column) -> Column:
    """A plain string, or the text blocks of an array; tool and thinking blocks are no text."""
    blocks = F.from_json(content, schema.BLOCKS)
    texts = F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), lambda t: T.strip(t) != "")
    return F.when(F.ltrim(content).startswith("["), F.coalesce(F.array_join(texts, "\n"), F.lit(""))).otherwise(F.coalesce(content, F.lit("")))


def message_tools(content: Column) -> Column:
    blocks = F.when(F.ltrim(content).startswith("["), F.from_json(content, schema.BLOCKS))
    return F.coalesce(F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: b["name"]), F.array().cast("array<string>"))


def exchanges(rows: DataFrame, first_answer_only: bool = False, most: int | None = None) -> DataFrame:
    """Records to exchanges: a user record with text opens one, assistant and summary text follow, joined by blank lines. Session,
    folder and time are the first that are told. `first_answer_only` and `most` cut as the validator's reader does."""
    r = rows.withColumns({"text": message_text(F.col("content")), "tools": message_tools(F.col("content"))})
    w = Window.partitionBy("file_path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("type") == "user") & (T.strip(F.col("text")) != "")
    r = r.withColumn("exchange", F.sum(opens.cast("int")).over(w)).filter("exchange > 0")
    item = F.struct("line", "type", "text", "tools")
    got = r.groupBy("file_path", "exchange").agg(F.sort_array(F.collect_list(item)).alias("x"), F.min_by("session", F.when(F.col("session").isNotNull(), F.col("line"))).alias("session"), F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line"))).alias("cwd"), F.min_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("line"))).alias("timestamp"), F.min("line").alias("start_line"), F.max("line").alias("end_line"))
    said = F.filter("x", lambda i: i["type"].isin("assistant", "summary") & (T.strip(i["text"]) != ""))
    if first_answer_only:
        said = F.slice(F.filter(said, lambda i: i["type"] == "assistant"), 1, 1)
    user = F.get(F.transform(F.filter("x", lambda i: i["type"] == "user"), lambda i: i["text"]), F.lit(0))
    answer = F.array_join(F.transform(said, lambda i: i["text"]), "\n\n")
    cut = (lambda c: F.substr(c, F.lit(1), F.lit(most))) if most else (lambda c: c)
    return got.select("file_path", "exchange", cut(user).alias("user"), cut(answer).alias("assistant"), F.array_distinct(F.flatten(F.transform("x", lambda i: i["tools"]))).alias("tools"), "session", "cwd", F.try_to_timestamp("timestamp").alias("ts"), "start_line", "end_line")


def rendered(rows: DataFrame) -> DataFrame:
    """One text a conversation, with a header."""
    part = F.concat(F.lit("[User]: "), "user", F.when(F.col("assistant") != "", F.concat(F.lit("\n\n[Assistant]: "), "assistant")).otherwise(F.lit("")))
    got = rows.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("exchange", part.alias("text")))).alias("x"), F.min("session").alias("session"), F.min("cwd").alias("cwd"), F.min("ts").alias("ts"))
    head = F.concat(F.lit("Session: "), F.coalesce("session", F.lit("")), F.lit("\nProject: "), F.coalesce("cwd", F.lit("")), F.lit("\nDate: "), F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("")))
    return got.select("file_path", F.concat(head, F.lit("\n\n"), F.array_join(F.transform("x", lambda i: i["text"]), "\n\n")).alias("content"))


def short_exchanges(rows: DataFrame, most: int = 500) -> DataFrame:
    """The validator's reading of records: a user record with text opens an exchange, the next assistant record with text closes it; a user
    nobody answers has an empty answer. Text blocks are joined by a space; both sides are stripped, then cut."""
    blocks = F.from_json("content", schema.BLOCKS)
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), " ")
    text = T.strip(F.when(F.ltrim(F.col("content")).startswith("["), F.coalesce(joined, F.lit(""))).otherwise(F.coalesce("content", F.lit(""))))
    said = rows.select("file_path", "line", "type", text.alias("text")).filter(F.col("type").isin("user", "assistant") & (F.col("text") != ""))
    w = Window.partitionBy("file_path").orderBy("line")
    said = said.withColumns({"exchange": F.sum((F.col("type") == "user").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead(F.struct("type", "text")).over(w)})
    cut = lambda c: F.substr(c, F.lit(1), F.lit(most))
    return said.filter("type = 'user'").select("file_path", "exchange", cut(F.col("text")).alias("user"), F.when(F.col("next.type") == "assistant", cut(F.col("next.text"))).otherwise(F.lit("")).alias("assistant"))
