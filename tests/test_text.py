import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomdex.functions import entities as E
from loomdex.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "content, ts, path, expected",
    [
        (None, "2025-03-15T10:30:00Z", "", "2025-03-15"),
        (None, "1736899200000", "", "2025-01-15"),
        (None, None, "memory/2025-06-20.md", "2025-06-20"),
        ("We deployed on 2025-04-10 and it worked.", None, "", "2025-04-10"),
        ("The meeting was on January 15, 2025.", None, "", "2025-01-15"),
        ("I fixed the bug yesterday", "2025-06-10T12:00:00", "", "2025-06-10"),
        ("I fixed the bug yesterday", None, "", "2025-05-31"),
        ("no date", None, "", None),
        (None, "2025-08-01T00:00:00", "memory/2025-01-01.md", "2025-08-01"),
    ],
)
def test_event_date(spark, content, ts, path, expected):
    got = one(spark, T.event_date(F.lit(content).cast("string"), F.lit(ts).cast("string"), F.lit(path), F.lit("2025-06-01").cast("date")))
    assert got == (dt.date.fromisoformat(expected) if expected else None)


@pytest.mark.parametrize("q, expected", [("on 2025-01-10", "2025-01-10"), ("march 2025 plan", "2025-03-15"), ("last monday", "2025-05-26"), ("this week", "2025-06-01"), ("hello", None)])
def test_query_date(spark, q, expected):
    got = one(spark, T.query_date(F.lit(q), F.lit("2025-06-01").cast("date")))
    assert str(got or None) == str(expected)


def test_titles(spark):
    t = F.lit("acme-analytics | 2025-01-15 | Tools: Read, Write")
    assert one(spark, T.title_project(t)) == "acme-analytics"
    assert one(spark, T.title_date(t)) == "2025-01-15"
    assert one(spark, T.title_tools(t)) == ["Read", "Write"]
    assert one(spark, T.normalize_project(F.lit("-Users-ann-lee-My-App"), "ann.lee")) == "my-app"
    assert one(spark, T.normalize_project(F.lit("--Users-bob-App"))) == "app"
    assert one(spark, T.index_path(F.lit("/home/x/projects/demo/a.jsonl"))) == "conversations/demo/a.jsonl"
    name = "demo_01234567-89ab-cdef-0123-456789abcdef_2025-01-01.jsonl"
    assert one(spark, T.archive_path(F.lit(name))) == "conversations/demo/01234567-89ab-cdef-0123-456789abcdef.jsonl"
    assert one(spark, T.archive_path(F.lit("x.jsonl"))) is None


@pytest.mark.parametrize("text", ["", "a" * 30, "one two. " + "x" * 20, "aaaa\n\nbbbbbb", "word " * 10, "abc. def ghi jkl mno pqr"])
def test_smart_truncate(spark, text):
    def plain(s, n):
        if len(s) <= n:
            return s
        h = s[:n]
        for place, extra in ((h.rfind("\n\n"), 0), (max(h.rfind(". "), h.rfind(".\n")), 1), (h.rfind(" "), 0)):
            if place > 0.6 * n:
                return h[: place + extra]
        return h

    assert one(spark, T.smart_truncate(F.lit(text), 12)) == plain(text, 12)


def test_small_functions(spark):
    assert one(spark, T.html_to_text(F.lit("<p>Hi <b>you</b></p><script>x()</script><nav>menu</nav>"))) == "Hi you"
    assert one(spark, T.judge_score(F.lit("SCORE: 8/10\nFEEDBACK: more"))) == 8.0
    assert one(spark, T.judge_feedback(F.lit("SCORE: 8/10\nFEEDBACK: more"))) == "more"
    assert one(spark, T.without_fences(F.lit("```json\n[1]\n```"))) == "[1]"
    assert one(spark, T.directory_distance(F.lit("a/b/x.py"), F.lit("a/c/d/y.py"))) == 3
    assert one(spark, T.directory_distance(F.lit("x.py"), F.lit("y.py"))) == 0
    assert [one(spark, T.scip_edge_type(F.lit(s))) for s in ("a#doWork().", "a#Interface", "a/b")] == ["calls", "extends", "import"]
    assert one(spark, T.tokens(F.lit("Café foo_bar 42"))) == ["cafe", "foo", "bar", "42"]
    assert one(spark, T.exchange_text(F.lit("a"), F.lit(""))) == "User: a"


def test_entities(spark):
    get = lambda content, title="": {tuple(x) for x in one(spark, E.entities(F.lit(content), F.lit(title)))}
    assert {("tool", "slack"), ("tool", "jira")} <= get("We use Slack and Jira for work")
    assert ("project", "acme-analytics") in get("x", "acme-analytics | 2025-01-15 | Tools: Read, Write")
    assert ("person", "ann lee") in get("met Ann Lee today")
    assert not [e for e in get("Monday Tuesday") if e[0] == "person"]


def test_entity_graph(spark):
    found = spark.createDataFrame([("c1", "tool", "slack"), ("c1", "tool", "jira"), ("c2", "tool", "slack"), ("c2", "tool", "docker"), ("c3", "tool", "docker"), ("c3", "tool", "github")], "chunk_id string, entity_type string, entity_value string")
    relations = E.co_occurrences(found)
    assert {(r["entity_a"], r["entity_b"]) for r in relations.collect()} == {("jira", "slack"), ("docker", "slack"), ("docker", "github")}
    assert {r["entity_value"]: r["mentions"] for r in E.browse(found).collect()} == {"slack": 2, "docker": 2, "jira": 1, "github": 1}
    assert {r["entity"] for r in E.neighbours(relations, "slack", 1).collect()} == {"jira", "docker"}
    assert [(r["entity"], r["via"]) for r in E.neighbours(relations, "slack", 2).filter("depth = 2").collect()] == [("github", "docker")]
