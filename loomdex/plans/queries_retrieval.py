"""Retrieval queries over documents, embeddings, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.functions import entities as E
from loomdex.functions import text as T
from loomdex.functions import vectors as V
from loomdex.operators import retrieve as R
from loomdex.plans import search as S
from loomdex.runtime import materialise, table

QUERIES, SQL = {}, {}
WORDS = "the render of"
VOCABULARY = ["render", "the", "nicht", "para", "les"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.concat_ws(" | ", "source", "lang").alias("title"), F.concat(F.lit("memory/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def first_vector(spark: SparkSession, sf: str) -> list[float]:
    return list(vectors(spark, sf).filter("id = 0").first()["embedding"])


TOKENS = f"regexp_extract_all(translate(lower(coalesce(text, '')), '{T.FOLD_FROM}', '{T.FOLD_TO}'), '[\\p{{L}}\\p{{N}}]+')"


def bm25_sql(terms: list[str], tokens: str = TOKENS) -> str:
    """Terms without underscores; a repeated one counts again."""
    different = list(dict.fromkeys(terms))
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(different))
    df = ", ".join(f"sum((tf{i} > 0)::INT) AS df{i}" for i in range(len(different)))
    part = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for w in terms for i in [different.index(w)])
    some = " OR ".join(f"tf{i} > 0" for i in range(len(different)))
    return f"""t AS (SELECT doc_id AS id, {tokens} AS t FROM documents),
c AS (SELECT id, len(t) AS dl, {tf} FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c),
bm AS (SELECT id, {part} AS score FROM c, s WHERE {some})"""


@query(f"WITH {bm25_sql(['the', 'render', 'of'])} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20")
def bm25_topk(spark, sf):
    return R.top(R.bm25(docs(spark, sf), WORDS), 20).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH t AS (SELECT doc_id AS id, {TOKENS} AS t FROM documents),
c AS (SELECT id, len(t) AS dl, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS tf FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, sum((tf > 0)::INT) AS df FROM c)
SELECT id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM c, s WHERE tf > 0 ORDER BY greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) DESC, id LIMIT 20""")
def bm25_phrase(spark, sf):
    return R.top(R.bm25(docs(spark, sf), "of_the"), 20).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {bm25_sql(['the', 'render', 'of'])} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20")
def bm25_inverted_index(spark, sf):
    rows = docs(spark, sf)
    index = materialise(R.postings(rows), "postings")
    return R.top(R.bm25_indexed(index, R.index_stats(rows, index), WORDS), 20).select("id", F.round("score", 6).alias("score"))


COSINE = "list_sum(list_transform(list_zip(a.embedding, q.e), lambda z: z[1]::DOUBLE * z[2])) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x)) * list_sum(list_transform(q.e, lambda x: x::DOUBLE * x)))"


@query(f"WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round({COSINE}, 6) AS score FROM embeddings a, q WHERE {COSINE} > 0 ORDER BY {COSINE} DESC, id LIMIT 20")
def cosine_topk(spark, sf):
    return R.top(R.cosine_scores(vectors(spark, sf), first_vector(spark, sf)), 20).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH e AS (SELECT vec_id, embedding[1:32] AS embedding FROM embeddings), q AS (SELECT embedding AS e FROM e WHERE vec_id = 0)
SELECT vec_id AS id, round({COSINE}, 6) AS score FROM e a, q WHERE {COSINE} > 0 ORDER BY {COSINE} DESC, id LIMIT 20""")
def matryoshka_topk(spark, sf):
    return R.top(R.cosine_scores(vectors(spark, sf), first_vector(spark, sf), dims=32), 20).select("id", F.round("score", 6).alias("score"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS id, len(list_filter(list_zip(a.embedding, q.e), lambda z: (z[1] > 0) <> (z[2] > 0)))::INT AS distance FROM embeddings a, q ORDER BY distance, id LIMIT 25""")
def hamming_topk(spark, sf):
    return R.hamming_scores(vectors(spark, sf), first_vector(spark, sf)).orderBy("distance", "id").limit(25)


_CODED: dict[tuple[str, str], DataFrame] = {}


def codes(spark, sf) -> DataFrame:
    """The vectors' codes, written once a session and folder of tables."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CODED:
        _CODED[key] = materialise(R.coded(vectors(spark, sf), 64), "codes")
    return _CODED[key]


@query()
def two_stage_topk(spark, sf):
    return R.two_stage(vectors(spark, sf), first_vector(spark, sf), 10, codes=codes(spark, sf))


@query()
def three_stage_topk(spark, sf):
    return R.three_stage(vectors(spark, sf), first_vector(spark, sf), 10, codes=codes(spark, sf))


@query()
def quantize_roundtrip(spark, sf):
    """Mean squared error of 4-bit codes, over all vectors."""
    rows = vectors(spark, sf).select("id", "embedding", V.dequantize(V.quantize(F.col("embedding"), 64), 64).alias("back"))
    error = F.aggregate(F.zip_with("embedding", "back", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", error.alias("error"), F.lit(V.packed_size(64, 4)).alias("code_bytes"))


HYBRID = f"""WITH {bm25_sql(['the', 'of'])}, q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
co AS (SELECT vec_id AS id, {COSINE} AS score FROM embeddings a, q WHERE {COSINE} > 0),
k AS (SELECT id, 1 AS list_no, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 40),
v AS (SELECT id, 0 AS list_no, row_number() OVER (ORDER BY score DESC, id) AS rank FROM co QUALIFY rank <= 40),
u AS (SELECT * FROM k UNION ALL SELECT * FROM v),
f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list_no) AS list_no, arg_min(rank, list_no) AS rank, count(*) AS n FROM u GROUP BY id)"""


@query(f"{HYBRID} SELECT id, round(score, 9) AS score, CASE WHEN n = 2 THEN 'hybrid' WHEN list_no = 0 THEN 'vector' ELSE 'keyword' END AS match_type FROM f ORDER BY f.score DESC, list_no, rank, id LIMIT 10")
def hybrid_match_type(spark, sf):
    got = R.hybrid(R.cosine_scores(vectors(spark, sf), first_vector(spark, sf)), R.bm25(docs(spark, sf), "the of"), 10)
    return got.select("id", F.round("score", 9).alias("score"), "match_type")


@query(f"{HYBRID} SELECT f.id, round(f.score, 9) AS score, f.list_no, f.rank::INT AS rank, length(d.text) AS n FROM f JOIN documents d ON d.doc_id = f.id ORDER BY f.score DESC, f.list_no, f.rank, f.id LIMIT 10")
def rrf_hybrid(spark, sf):
    """Flagship: keyword and vector lists fused by rank, joined to their texts."""
    keyword = R.ranked(R.bm25(docs(spark, sf), "the of"), 1, 40)
    vector = R.ranked(R.cosine_scores(vectors(spark, sf), first_vector(spark, sf)), 0, 40)
    best = R.fuse([vector, keyword])
    return F.broadcast(best).join(docs(spark, sf), "id").orderBy(*R.fused_order()).limit(10).select("id", F.round("score", 9).alias("score"), "list_no", "rank", F.length("content").cast("long").alias("n"))


DAYS = "SELECT event_id AS id, ts::DATE AS d FROM events"


@query("""WITH n AS (SELECT event_id AS id, abs(date_diff('day', ts::DATE, DATE '2024-01-15')) AS days FROM events ORDER BY days, id LIMIT 90)
SELECT id, round(exp(-power(days, 2) / 98.0), 9) AS score FROM n WHERE exp(-power(days, 2) / 98.0) >= 0.01 ORDER BY score DESC, id LIMIT 30""")
def temporal_decay(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("date").alias("event_date"))
    return R.temporal_scores(rows, "2024-01-15", 30).select("id", F.round("score", 9).alias("score"))


PERSONS = """SELECT DISTINCT doc_id AS chunk_id, 'person' AS entity_type, lower(p) AS entity_value FROM (
  SELECT doc_id, unnest(regexp_extract_all(' ' || text || ' ', '[^\\p{L}\\p{N}_]([A-Z][a-z]+\\s+[A-Z][a-z]+)', 1)) AS p FROM documents)"""


def entity_rows(spark, sf):
    return E.chunk_entities(docs(spark, sf), vocabulary=VOCABULARY)


TOOL_ROWS = "SELECT doc_id AS chunk_id, 'tool' AS entity_type, w AS entity_value FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(source || ' | ' || lang || ' ' || text), '[\\p{L}\\p{N}_]+'))) AS w FROM documents) WHERE w IN ('render', 'the', 'nicht', 'para', 'les')"


@query(f"SELECT entity_value, count(*) AS chunks FROM ({TOOL_ROWS}) GROUP BY 1")
def entity_extract(spark, sf):
    return entity_rows(spark, sf).filter("entity_type = 'tool'").groupBy("entity_value").agg(F.count("*").alias("chunks"))


@query(f"SELECT entity_value, entity_type, count(*) AS mentions FROM ({TOOL_ROWS} UNION ALL SELECT doc_id, 'project', source FROM documents) GROUP BY ALL HAVING entity_value LIKE '%r%' ORDER BY mentions DESC, entity_value, entity_type LIMIT 15")
def entity_browse(spark, sf):
    return E.browse(entity_rows(spark, sf).filter("entity_type <> 'person'"), query="r", limit=15)


@query(f"SELECT chunk_id AS id, round(count(DISTINCT entity_value) / 3.0, 6) AS score FROM ({TOOL_ROWS}) WHERE entity_value IN ('render', 'the', 'les') GROUP BY 1 ORDER BY score DESC, id LIMIT 25")
def entity_overlap(spark, sf):
    scored = R.entity_scores(entity_rows(spark, sf), [("tool", "render"), ("tool", "the"), ("tool", "les")])
    return R.top(scored, 25).select("id", F.round("score", 6).alias("score"))


@query(f"WITH e AS ({TOOL_ROWS} UNION ALL SELECT doc_id, 'project', source FROM documents) SELECT a.entity_value AS entity_a, b.entity_value AS entity_b, count(*) AS n FROM (SELECT DISTINCT chunk_id, entity_value FROM e) a JOIN (SELECT DISTINCT chunk_id, entity_value FROM e) b ON a.chunk_id = b.chunk_id AND a.entity_value < b.entity_value GROUP BY ALL")
def cooccurrence_pairs(spark, sf):
    pairs = E.co_occurrences(entity_rows(spark, sf).filter("entity_type <> 'person'"))
    return pairs.groupBy("entity_a", "entity_b").agg(F.count("*").alias("n"))


BASKET = """b AS (SELECT DISTINCT l_orderkey AS c, 'p' || (l_partkey % 50) AS v FROM lineitem),
r AS (SELECT x.v AS a, y.v AS b FROM b x JOIN b y ON x.c = y.c AND x.v < y.v),
n AS (SELECT a AS x, b AS y, count(*) AS strength FROM (SELECT * FROM r UNION ALL SELECT b, a FROM r) GROUP BY ALL)"""


def relations(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("entity_value"))
    return E.co_occurrences(items)


@query(f"WITH {BASKET} SELECT 1 AS depth, y AS entity, strength FROM n WHERE x = 'p7' ORDER BY strength DESC, entity LIMIT 12")
def entity_graph_d1(spark, sf):
    return E.neighbours(relations(spark, sf), "p7", 1, 12).select("depth", "entity", "strength")


@query(f"""WITH {BASKET}, one AS (SELECT y, strength FROM n WHERE x = 'p7' ORDER BY strength DESC, y LIMIT 12),
s AS (SELECT * FROM one ORDER BY strength DESC, y LIMIT 10),
two AS (SELECT n.y, s.y AS via, n.strength, row_number() OVER (PARTITION BY n.y ORDER BY s.strength DESC, s.y) AS k FROM n JOIN s ON n.x = s.y WHERE n.y <> 'p7' AND n.y NOT IN (SELECT y FROM one))
SELECT 1 AS depth, y AS entity, NULL AS via, strength FROM one UNION ALL SELECT * FROM (SELECT 2 AS depth, y AS entity, via, strength FROM two WHERE k = 1 ORDER BY strength DESC, entity LIMIT 12)""")
def entity_graph_d2(spark, sf):
    return E.neighbours(relations(spark, sf), "p7", 2, 12)


def talks(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.concat(F.lit("conversations/p"), (F.col("conv_id") % 7).cast("string"), F.lit("/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file_path"), F.concat(F.lit("-Users-ann-Proj"), (F.col("conv_id") % 7).cast("string"), F.lit(" | 2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0")).alias("title"), F.col("text").alias("content"))


TALKS = f"""t AS (SELECT conv_id || ':' || turn AS id, 'conversations/p' || (conv_id % 7) || '/' || conv_id || '.jsonl' AS file_path, conv_id, turn, text FROM conversations),
tt AS (SELECT id, file_path, conv_id, regexp_extract_all(translate(lower(coalesce(text, '')), '{T.FOLD_FROM}', '{T.FOLD_TO}'), '[\\p{{L}}\\p{{N}}]+') AS t FROM t)"""
TALK_BM = """c AS (SELECT id, file_path, conv_id, len(t) AS dl, len(list_filter(t, lambda x: x = 'the')) AS tf FROM tt),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, sum((tf > 0)::INT) AS df FROM c),
bm AS (SELECT id, file_path, conv_id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM c, s WHERE tf > 0),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 60)"""


@query(f"WITH {TALKS}, {TALK_BM}, w AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY rank) AS k FROM r QUALIFY k <= 2) SELECT id, file_path, rank::INT AS rank FROM w ORDER BY rank LIMIT 20")
def search_session_cap(spark, sf):
    rows = talks(spark, sf)
    fused = R.fuse([R.ranked(R.bm25(rows, "the"), 0, 60)])
    got = R.session_cap(F.broadcast(fused).join(rows, "id"))
    return got.orderBy(*R.fused_order()).limit(20).select("id", "file_path", "rank")


@query(f"WITH {TALKS.replace('FROM t)', 'FROM t WHERE conv_id % 7 = 3 AND conv_id % 28 + 1 BETWEEN 5 AND 20)')}, {TALK_BM.replace('len(t) AS dl', 'len(t) + 6 AS dl')}, w AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY rank) AS k FROM r QUALIFY k <= 2) SELECT id, round(1.0 / (60 + rank), 9) AS score FROM w ORDER BY rank LIMIT 6")
def search_filters(spark, sf):
    """Titles hold six tokens each, which count for length."""
    catalog = S.Catalog(talks(spark, sf).drop("title").withColumn("title", F.lit("")).join(talks(spark, sf).select("id", F.col("title").alias("meta")), "id"))
    catalog.chunks = catalog.chunks.withColumn("title", F.col("meta")).drop("meta")
    got = S.memory_search(catalog, "the", 6, after="2024-01-05", before="2024-01-20", project="proj3", source="conversations", use=("keyword",))
    return got.select("id", F.round("score", 9).alias("score"))


_INDEXED: dict[tuple[str, str], S.Catalog] = {}


def store(spark, sf) -> S.Catalog:
    """The documents as a store without an index: what reads no texts needs none."""
    first = first_vector(spark, sf)
    rows = docs(spark, sf).join(vectors(spark, sf).select("id", "embedding"), "id", "left").withColumn("event_date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 60).cast("int")))
    return S.Catalog(rows, embed=lambda q: first, vocabulary=VOCABULARY)


def catalog(spark, sf) -> S.Catalog:
    """The store with its index; built once a session and folder of tables, as a store's index is."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXED:
        _INDEXED[key] = S.indexed(store(spark, sf))
    return _INDEXED[key]


ASKED = "what the render of les did on 2024-01-20"
TITLED = TOKENS.replace("coalesce(text, '')", "source || ' | ' || lang || ' ' || coalesce(text, '')")


@query(f"""WITH {bm25_sql(["what", "the", "render", "of", "les", "did", "on", "2024", "01", "20"], TITLED)}, q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
co AS (SELECT vec_id AS id, {COSINE} AS score FROM embeddings a, q WHERE {COSINE} > 0 AND vec_id IN (SELECT doc_id FROM documents)),
te AS (SELECT doc_id AS id, abs(doc_id % 60 - 19) AS days FROM documents ORDER BY days, id LIMIT 180),
en AS (SELECT chunk_id AS id, count(DISTINCT entity_value) / 3.0 AS score FROM ({TOOL_ROWS}) WHERE entity_value IN ('render', 'the', 'les') GROUP BY 1),
u AS (SELECT id, 0 AS list_no, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 60
  UNION ALL SELECT id, 1, row_number() OVER (ORDER BY score DESC, id) AS rank FROM co QUALIFY rank <= 60
  UNION ALL SELECT id, 2, row_number() OVER (ORDER BY exp(-power(days, 2) / 98.0) DESC, id) AS rank FROM te WHERE exp(-power(days, 2) / 98.0) >= 0.01 QUALIFY rank <= 60
  UNION ALL SELECT id, 3, row_number() OVER (ORDER BY score DESC, id) AS rank FROM en QUALIFY rank <= 60),
f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list_no) AS list_no, arg_min(rank, list_no) AS rank FROM u GROUP BY id)
SELECT row_number() OVER (ORDER BY round(f.score, 12) DESC, f.list_no, f.rank, f.id)::INT AS position, f.id, round(f.score, 9) AS score, d.source || ' | ' || d.lang AS title, 'curated' AS source, DATE '2024-01-01' + (f.id % 60)::INT AS entry_date
FROM f JOIN documents d ON d.doc_id = f.id ORDER BY position LIMIT 10""")
def memory_search(spark, sf):
    got = S.memory_search(catalog(spark, sf), ASKED, 10)
    return got.select("position", "id", F.round("score", 9).alias("score"), "title", "source", "entry_date")


@query()
def deep_search(spark, sf):
    return S.memory_deep_search(catalog(spark, sf), "render on 2024-01-20", 10)


@query()
def deep_search_filtered(spark, sf):
    """Both passes keep to the dates and the source."""
    return S.memory_deep_search(catalog(spark, sf), "render on 2024-01-20", 10, after="2024-01-10", before="2024-02-05", source="curated")


@query(f"""WITH {bm25_sql(["the", "render"], TITLED)}
SELECT id, round(1 / (1 + bm.score), 9) AS score, 'keyword' AS match_type FROM bm ORDER BY round(1 / (1 + bm.score), 9) DESC, id LIMIT 15""")
def keyword_mode(spark, sf):
    """Scores of a full-text rank: 1 / (1 - rank), the rank being the negative score."""
    got = S.search(catalog(spark, sf), "the render", "keyword", 10**6)
    return got.select("id", F.round("score", 9).alias("score"), "match_type").orderBy(F.desc("score"), "id").limit(15)


DISTANCE = "sqrt(list_sum(list_transform(list_zip(a.embedding, q.e), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))))"


@query(f"""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS id, round(1 - {DISTANCE}, 6) AS score, 'vector' AS match_type FROM embeddings a, q WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY {DISTANCE}, id LIMIT 10""")
def vector_mode_by_distance(spark, sf):
    got = S.search(store(spark, sf), "any", "vector", 10, min_score=-1e9, metric="l2")
    return got.select("id", F.round("score", 6).alias("score"), "match_type")


@query()
def packed_search(spark, sf):
    """Half of the vectors are packed codes; the rest, float vectors alone, are a list that is fused with theirs."""
    own = store(spark, sf)
    got = S.memory_search(S.replace(own, codes=codes(spark, sf).filter("id % 2 = 0").select("id", "code4")), ASKED, 10, use=("vector",))
    return got.select("position", "id", F.round("score", 9).alias("score"))


@query("SELECT 'curated' AS source, count(*) AS chunks, count(DISTINCT doc_id) AS files, sum((doc_id NOT IN (SELECT vec_id FROM embeddings))::INT)::BIGINT AS without_embedding FROM documents")
def store_status(spark, sf):
    return S.status(store(spark, sf))


@query("""WITH q AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS qid, q.label AS ql, e.label AS l, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: z[1]::DOUBLE * z[2])) DESC, e.vec_id) AS k FROM q JOIN embeddings e ON e.vec_id <> q.vec_id)
SELECT ql AS category, count(DISTINCT qid) AS queries, round(avg((l = ql)::INT), 6) AS precision_at_10 FROM s WHERE k <= 10 GROUP BY 1""")
def recall_at_k(spark, sf):
    """Labels as relevance; a stated query set against all rows."""
    v = vectors(spark, sf)
    best = R.top_k_many(v, v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), 10, 64)
    side = lambda key, label: v.select(F.col("id").alias(key), F.col("label").alias(label))
    best = best.withColumnRenamed("query_id", "qid").join(side("id", "label"), "id").join(side("qid", "category"), "qid")
    return best.groupBy("category").agg(F.count_distinct("qid").alias("queries"), F.round(F.avg((F.col("label") == F.col("category")).cast("int")), 6).alias("precision_at_10"))


@query("SELECT lang, count(*) AS n, sum((text ILIKE '%render%')::INT) AS hits FROM documents GROUP BY 1")
def source_filter(spark, sf):
    rows = table(spark, sf, "documents")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.col("text").ilike("%render%").cast("int")).cast("long").alias("hits"))
