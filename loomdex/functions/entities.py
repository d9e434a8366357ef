"""Entities of a text, and pairs that occur together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions import text as T

# Tool vocabulary.
TOOLS = (
    "claude", "slack", "jira", "github", "datadog", "splunk", "sourcegraph", "grafana", "terraform", "docker", "kubernetes", "aws", "gcp", "azure", "redis", "postgres",
    "postgresql", "mysql", "mongodb", "dynamodb", "elasticsearch", "kibana", "jenkins", "circleci", "buildkite", "confluence", "notion", "linear", "figma", "vercel",
    "netlify", "heroku", "flyio", "render", "supabase", "firebase", "stripe", "twilio", "sendgrid", "openai", "anthropic", "bedrock", "sagemaker", "databricks",
    "snowflake", "bigquery", "airflow", "dagster", "dbt", "spark", "kafka", "rabbitmq", "nginx", "caddy", "traefik", "python", "typescript", "javascript", "rust",
    "golang", "java", "ruby", "react", "nextjs", "django", "flask", "fastapi", "rails", "springboot", "zeppelin", "datahub", "artifactory", "gradle", "maven", "npm",
    "yarn", "pnpm", "pip", "poetry", "conda",
)

# Capitalised words that are no names.
NO_NAMES = (
    "the", "this", "that", "with", "from", "into", "have", "been", "will", "when", "what", "where", "which", "there", "their", "these", "those", "about", "after",
    "before", "between", "could", "would", "should", "also", "just", "then", "than", "some", "other", "more", "most", "only", "very", "each", "every", "both", "either",
    "neither", "here", "over", "under", "again", "once", "much", "many", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january",
    "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "todo", "note", "update", "error", "warning", "info",
    "debug", "test", "tests", "testing", "setup", "config", "step",
)

PERSON = r"(?<![\p{L}\p{N}_])([A-Z][a-z]+\s+[A-Z][a-z]+)(?![\p{L}\p{N}_])"
ENTITY = "array<struct<entity_type:string,entity_value:string>>"


def entities(content: Column, title: Column, vocabulary: list[str] | None = None) -> Column:
    """Tools of title and content, the title's project, persons of the content; each (type, value) once, ordered by both."""
    tools = vocabulary if vocabulary is not None else TOOLS
    seen = T.words(F.concat_ws(" ", title, content))
    as_type = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("entity_type"), F.lower(v).alias("entity_value")))
    project = F.array_compact(F.array(T.title_project(title)))
    stop = F.array(*map(F.lit, [*NO_NAMES, *tools]))
    names = F.filter(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(PERSON), F.lit(1)), lambda n: F.forall(F.split(n, r"\s+"), lambda p: ~F.array_contains(stop, F.lower(p))))
    every = F.concat(as_type("tool", F.array_intersect(seen, F.array(*map(F.lit, tools)))), as_type("project", project), as_type("person", names))
    return F.array_sort(F.array_distinct(every))


def chunk_entities(chunks: DataFrame, id_col: str = "id", content: str = "content", title: str = "title", vocabulary: list[str] | None = None) -> DataFrame:
    """chunk_id, entity_type, entity_value."""
    return chunks.select(F.col(id_col).alias("chunk_id"), F.inline(entities(F.col(content), F.col(title), vocabulary)))


def co_occurrences(found: DataFrame) -> DataFrame:
    """entity_a < entity_b of one chunk, over different values. The pairs of a chunk are built in its own row, so one shuffle."""
    values = found.groupBy("chunk_id").agg(F.array_sort(F.collect_set("entity_value")).alias("v")).filter(F.size("v") > 1)
    pairs = F.flatten(F.transform("v", lambda a, i: F.transform(F.slice(F.col("v"), i + 2, F.size("v")), lambda b: F.struct(a.alias("entity_a"), b.alias("entity_b")))))
    return values.select("chunk_id", F.inline(pairs)).select("entity_a", F.lit("co_occurrence").alias("relation_type"), "entity_b", "chunk_id", F.lit(1.0).alias("confidence"))


def browse(found: DataFrame, kind: str | None = None, query: str | None = None, limit: int = 50) -> DataFrame:
    """Values by how often they occur. The query is matched literally, in either case."""
    limit = max(1, min(limit, 200))
    rows = found
    if kind:
        rows = rows.filter(F.col("entity_type") == kind)
    if query:
        rows = rows.filter(F.contains(F.lower("entity_value"), F.lit(query.lower())))
    return rows.groupBy("entity_value", "entity_type").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "entity_value", "entity_type").limit(limit)


def neighbours(relations: DataFrame, entity: str, depth: int = 1, limit: int = 20) -> DataFrame:
    """depth, entity, via, strength. Depth 2 starts at the first ten neighbours; each entity comes once, by its first way."""
    depth, limit = max(1, min(depth, 2)), max(1, min(limit, 100))
    both = relations.select(F.col("entity_a").alias("x"), F.col("entity_b").alias("y")).union(relations.select("entity_b", "entity_a"))
    counted = both.groupBy("x", "y").agg(F.count("*").alias("strength"))
    one = counted.filter(F.col("x") == entity.lower()).orderBy(F.desc("strength"), "y").limit(limit).select(F.lit(1).alias("depth"), F.col("y").alias("entity"), F.lit(None).cast("string").alias("via"), "strength")
    if depth == 1:
        return one
    starts = one.orderBy(F.desc("strength"), "entity").limit(10).select(F.col("entity").alias("via"), F.col("strength").alias("s1"))
    two = counted.join(F.broadcast(starts), counted["x"] == starts["via"]).filter(F.col("y") != entity.lower())
    two = two.join(F.broadcast(one.select(F.col("entity").alias("y"))), "y", "left_anti")
    best = two.groupBy("y").agg(F.min_by(F.struct("via", "strength"), F.struct(-F.col("s1"), F.col("via"))).alias("b"))
    second = best.select(F.lit(2).alias("depth"), F.col("y").alias("entity"), F.col("b.via").alias("via"), F.col("b.strength").alias("strength")).orderBy(F.desc("strength"), "entity").limit(limit)
    return one.unionByName(second)
