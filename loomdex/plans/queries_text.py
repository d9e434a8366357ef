"""Segmentation and text-function queries over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdex.functions import text as T
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


def turns(spark, sf):
    return table(spark, sf, "conversations")


EXCHANGES = """n AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS exchange FROM conversations),
x AS (SELECT conv_id, exchange, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS u, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS a, min(turn) AS s, max(turn) AS e FROM n WHERE exchange > 0 GROUP BY ALL),
k AS (SELECT * FROM x WHERE trim(u) <> '')"""


@query(f"WITH {EXCHANGES} SELECT conv_id, exchange::BIGINT AS exchange, length(u) AS user_chars, length(a) AS assistant_chars, s AS start_turn, e AS end_turn FROM k")
def exchanges(spark, sf):
    return S.exchanges(turns(spark, sf)).select("conv_id", F.col("exchange").cast("long").alias("exchange"), F.length("user").cast("long").alias("user_chars"), F.length("assistant").cast("long").alias("assistant_chars"), "start_turn", "end_turn")


@query(f"""WITH RECURSIVE {EXCHANGES}, o AS (SELECT conv_id, exchange, 6 + length(u) + CASE WHEN a <> '' THEN 13 + length(a) ELSE 0 END AS c, row_number() OVER (PARTITION BY conv_id ORDER BY exchange) AS i FROM k),
f(conv_id, i, sum, g) AS (SELECT conv_id, 1, c, 0 FROM o WHERE i = 1 UNION ALL
  SELECT o.conv_id, o.i, CASE WHEN f.sum + c > 1600 THEN c ELSE f.sum + c END, g + (f.sum + c > 1600)::INT FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1)
SELECT f.conv_id, g::INT AS chunk_index, count(*) AS n_exchanges, (sum(c) + 7 * (count(*) - 1))::BIGINT AS n_chars FROM f JOIN o USING (conv_id, i) GROUP BY ALL""")
def exchange_chunks(spark, sf):
    return S.exchange_chunks(S.exchanges(turns(spark, sf))).select("conv_id", "chunk_index", "n_exchanges", F.length("content").cast("long").alias("n_chars"))


@query(f"""WITH {EXCHANGES}, d AS (SELECT conv_id, exchange, trim(u) AS u, list_distinct(list_filter(list_transform(regexp_extract_all(u || chr(10) || a, '(?:/[A-Za-z0-9_./-]+){{2,}}'), lambda p: regexp_replace(p, '/[^/]+$', '')), lambda p: length(p) > 1)) AS dirs FROM k),
l AS (SELECT *, lag(dirs) OVER w AS pd, row_number() OVER w AS n FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY exchange))
SELECT conv_id, exchange::BIGINT AS exchange, least(3.0, CASE WHEN regexp_matches(u, '(?i)^(?:(?:now\\s+)?(?:let''?s|can you|please|could you)\\s+(?:switch|move|look at|work on|focus on|do|try|change)|(?:different|another|new|next|unrelated)\\s+(?:question|topic|task|thing|issue)|(?:ok(?:ay)?|alright|moving on|anyway)\\s*[,.]?\\s|(?:btw|by the way|also|separately|on a different note)|(?:forget|never\\s*mind|scratch that|ignore)\\s|(?:back to|returning to|going back to))') THEN 1.5 ELSE 0 END
  + CASE WHEN len(pd) > 0 AND len(dirs) > 0 AND NOT list_has_any(pd, dirs) THEN 1.0 ELSE 0 END + CASE WHEN regexp_matches(u, '\\?\\s*$') THEN 0.25 ELSE 0 END)::DOUBLE AS score FROM l WHERE n > 1""")
def exchange_boundary_score(spark, sf):
    return S.boundary_scores(S.exchanges(turns(spark, sf))).select("conv_id", F.col("exchange").cast("long").alias("exchange"), F.col("score").cast("double").alias("score"))


@query()
def dp_segments(spark, sf):
    x = S.exchanges(turns(spark, sf)).withColumn("exchange", F.col("exchange").cast("long"))
    return S.conversation_segments(x, S.boundary_scores(x))


@query(f"""WITH {EXCHANGES}, t AS (SELECT conv_id, exchange, 6 + length(u) + CASE WHEN a <> '' THEN 13 + length(a) ELSE 0 END AS n FROM k),
l AS (SELECT *, lag(n) OVER (PARTITION BY conv_id ORDER BY exchange) AS p FROM t)
SELECT conv_id, exchange::BIGINT AS exchange, (CASE WHEN abs(n - p) > 0.5 * greatest(n, p) THEN 3.0 ELSE 0.0 END)::DOUBLE AS score FROM l WHERE p IS NOT NULL""")
def boundary_model_windows(spark, sf):
    """The windowed scorer with a stand-in model: a break where lengths differ by half."""
    x = S.exchanges(turns(spark, sf)).withColumn("exchange", F.col("exchange").cast("long"))
    return S.window_scores(x, lambda w: [3.0 * (abs(len(a) - len(b)) > 0.5 * max(len(a), len(b))) for a, b in zip(w, w[1:])])


def notes(spark, sf):
    """Documents as markdown: sentences that end a line become headings, lists and tables by their number."""
    d = table(spark, sf, "documents")
    mark = F.transform(F.split("text", "\n"), lambda s, i: F.when(i % 7 == 0, F.concat(F.lit("## "), F.substr(s, F.lit(1), F.lit(30)), F.lit("\n"), s)).when(i % 5 == 0, F.concat(F.lit("- "), s)).when(i % 11 == 3, F.lit("---")).otherwise(F.concat(s, F.lit("\n"))))
    return d.select(F.concat(F.lit("memory/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.array_join(mark, "\n").alias("content"))


@query()
def markdown_units(spark, sf):
    return S.units(notes(spark, sf)).drop("text")


@query()
def markdown_chunks(spark, sf):
    return S.markdown_chunks(notes(spark, sf)).select("file_path", "chunk_index", "title", "start_line", "end_line")


@query()
def line_chunks(spark, sf):
    return S.line_chunks(notes(spark, sf)).select("file_path", "chunk_index", "start_line", "end_line", T.content_hash(F.col("content")).alias("hash"))


@query("""WITH m AS (SELECT doc_id, list_transform(range(1, len(string_split(text, chr(10))) + 1), lambda i: CASE WHEN (i - 1) % 7 = 0 THEN '## ' || left(string_split(text, chr(10))[i], 30) || chr(10) || string_split(text, chr(10))[i] WHEN (i - 1) % 5 = 0 THEN '- ' || string_split(text, chr(10))[i] WHEN (i - 1) % 11 = 3 THEN '---' ELSE string_split(text, chr(10))[i] || chr(10) END) AS p FROM documents),
l AS (SELECT doc_id, unnest(string_split(array_to_string(p, chr(10)), chr(10))) AS line FROM m)
SELECT 'memory/' || doc_id || '.md' AS file_path, sum((line LIKE '## %')::INT)::BIGINT AS parts FROM l GROUP BY doc_id HAVING sum((line LIKE '## %')::INT) > 0""")
def heading_chunks(spark, sf):
    return S.by_heading(notes(spark, sf)).groupBy("file_path").agg(F.count("*").alias("parts"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS x FROM documents) SELECT 'd/' || doc_id AS file_path, (sum(length(x)) + 2 * (count(*) - 1))::BIGINT AS n_chars FROM p GROUP BY doc_id""")
def plain_chunks(spark, sf):
    """All of a text's pieces, added up again with their separators."""
    d = table(spark, sf, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"))
    got = S.plain_chunks(d).groupBy("file_path").agg(F.sum(F.length("content")).alias("n"), F.count("*").alias("k"))
    return got.select("file_path", (F.col("n") + 2 * (F.col("k") - 1)).alias("n_chars"))


TAGS = "html"
for _tag in ("script", "style", "nav", "header", "footer", "noscript"):
    TAGS = f"regexp_replace({TAGS}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace({TAGS}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS content FROM pages")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_to_text(F.col("html")).alias("content"))


@query("SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, '(?m)^#+\\s+(.+)$', 1)), ''), 'n' || doc_id) AS title, ceil(length(text) / 4.0)::INT AS rough_tokens FROM documents")
def title_extract(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.extract_title(F.col("text"), F.concat(F.lit("memory/n"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("title"), T.rough_tokens(F.col("text")).alias("rough_tokens"))


LAST = "CASE WHEN strpos(reverse(h), '{0}') > 0 THEN length(h) - strpos(reverse(h), '{0}') - {1} + 1 ELSE -1 END"


@query(f"""WITH h AS (SELECT doc_id, text, left(text, 300) AS h FROM documents),
p AS (SELECT *, {LAST.format("' || chr(10) || chr(10) || '", 2)} AS a, greatest({LAST.format(" .", 2)}, {LAST.format("' || chr(10) || '.", 2)}) AS b, {LAST.format(" ", 1)} AS c FROM h)
SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN a > 180 THEN left(h, a) WHEN b > 180 THEN left(h, b + 1) WHEN c > 180 THEN left(h, c) ELSE h END AS cut FROM p""")
def smart_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.smart_truncate(F.col("text"), 300).alias("cut"))


@query("""SELECT doc_id, lower(regexp_replace(regexp_replace('-Users-ann-' || source || '-' || lang, '(?i)^-*Users-[^/\\\\-]+-', ''), '^[-/\\\\]+', '')) AS project FROM documents""")
def normalize_project(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_project(F.concat(F.lit("-Users-ann-"), "source", F.lit("-"), "lang")).alias("project"))


@query("SELECT doc_id, source AS project, DATE '2024-01-01' + (doc_id % 28)::INT AS day FROM documents")
def parse_title(spark, sf):
    d = table(spark, sf, "documents")
    title = F.concat_ws(" | ", "source", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).cast("string"), F.lit("Tools: Read, Write"))
    return d.select("doc_id", T.title_project(title).alias("project"), T.day(T.title_date(title)).alias("day"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts::DATE WHEN 1 THEN ts::DATE WHEN 2 THEN ts::DATE ELSE ts::DATE - 1 END AS day FROM events""")
def event_dates(spark, sf):
    """ISO, path, English and relative dates, each from a quarter of the events."""
    e = table(spark, sf, "events").withColumn("d", F.col("ts").cast("date"))
    n = F.col("event_id") % 4
    content = F.when(n == 0, F.concat(F.lit("done on "), F.col("d").cast("string"), F.lit("."))).when(n == 2, F.concat(F.lit("It was "), F.date_format("d", "MMMM d, yyyy"), F.lit("!"))).when(n == 3, F.lit("I did it yesterday")).otherwise(F.lit("nothing"))
    path = F.when(n == 1, F.concat(F.lit("memory/"), F.col("d").cast("string"), F.lit(".md"))).otherwise(F.lit("memory/x.md"))
    return e.select("event_id", T.event_date(content, F.lit(None).cast("string"), path, F.col("d")).alias("day"))


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN ts::DATE WHEN 1 THEN ts::DATE WHEN 2 THEN date_trunc('month', ts)::DATE + 14 ELSE NULL END AS day FROM events""")
def matching_query_date(spark, sf):
    """Questions that name an event's day by ISO date or in English, its month alone, or none."""
    e = table(spark, sf, "events").withColumn("d", F.col("ts").cast("date"))
    n = F.col("event_id") % 4
    q = F.when(n == 0, F.concat(F.lit("what about "), F.col("d").cast("string"), F.lit("?"))).when(n == 1, F.concat(F.lit("notes of "), F.date_format("d", "MMMM d, yyyy"))).when(n == 2, F.concat(F.lit("the "), F.lower(F.date_format("d", "MMMM yyyy")), F.lit(" plan"))).otherwise(F.lit("nothing"))
    return e.select(F.col("event_id").alias("id"), T.query_date(q, F.lit("2024-05-15").cast("date")).alias("day"))


@query(f"""WITH {EXCHANGES}, o AS (SELECT conv_id, exchange, (conv_id + exchange) % 6 AS v, a FROM k)
SELECT conv_id, exchange::BIGINT AS exchange, v IN (0, 1) OR (v = 3 AND trim(a, ' ' || chr(10) || chr(9) || chr(13)) = '') OR v = 4 AS noise FROM o""")
def session_noise(spark, sf):
    """Exchanges with known openings and parts put in: opening; opening; opening after a space; part; part without an answer; none."""
    x = S.exchanges(turns(spark, sf)).withColumn("v", (F.col("conv_id") + F.col("exchange")) % 6)
    mark = F.element_at(F.array(*map(F.lit, ("Edit operation feedback ", "Write operation feedback: ", " Edit operation feedback ", "see PreToolUse ", "a local-command-caveat ", "so "))), (F.col("v") + 1).cast("int"))
    user = F.concat(mark, "user")
    answer = F.when(F.col("v") == 4, F.lit(" \n")).otherwise(F.col("assistant"))
    return x.select("conv_id", F.col("exchange").cast("long").alias("exchange"), T.is_noise(user, answer).alias("noise"))
