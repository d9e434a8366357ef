"""Ranked retrieval: each operator takes rows and returns (id, score) or a fused list; ranks are explicit columns."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions import text as T
from loomdex.functions import vectors as V
from loomdex.runtime import materialise

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def query_terms(query: str) -> list[str]:
    """[A-Za-z0-9_]+ runs, in order, repeats kept; each is a term or, with underscores, a phrase."""
    return re.findall(r"[A-Za-z0-9_]+", query)


def match_expression(query: str) -> str:
    return " OR ".join(f'"{t}"' for t in query_terms(query))


def bm25_score(rank: Column) -> Column:
    """1 / (1 - rank) for the negative ranks of a full-text index; 0 for what is no number."""
    return F.coalesce(F.when(~F.isnan(rank), 1 / (1 - rank)), F.lit(0.0))


def phrase_count(tokens: Column, parts: list[str]) -> Column:
    """Places where the parts stand side by side; one walk over the tokens, so they are computed once."""
    if len(parts) == 1:
        return F.size(F.filter(tokens, lambda t: t == parts[0]))
    m = len(parts)
    zero = F.struct(F.array_repeat(F.lit(""), m).alias("last"), F.lit(0).alias("n"))
    wanted = F.array(*map(F.lit, parts))

    def step(a: Column, t: Column) -> Column:
        last = F.concat(F.slice(a["last"], 2, m - 1), F.array(t))
        return F.struct(last.alias("last"), (a["n"] + (last == wanted).cast("int")).alias("n"))

    return F.aggregate(tokens, zero, step, lambda a: a["n"])


def bm25(rows: DataFrame, query: str, id_col: str = "id", columns: dict[str, float] | None = None) -> DataFrame:
    """(id, score) of rows that hold any term. One pass over the texts, whose counts (a few numbers a row) are written and read
    again for the global aggregate and the scores; no shuffle.

    columns: text columns and their weights. A term that the query repeats counts again; length counts all columns' tokens."""
    columns = columns or {"content": 1.0}
    phrases = [[p for p in re.split("_+", t.lower()) if p] for t in query_terms(query)]
    phrases = [p for p in phrases if p]
    if not phrases:
        return rows.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    distinct = list(dict.fromkeys(map(tuple, phrases)))
    arrays = {c: T.tokens(F.col(c)) for c in columns}
    base = rows.select(F.col(id_col).alias("id"), *(a.alias(f"_t{i}") for i, a in enumerate(arrays.values())))
    length = reduce(lambda a, b: a + b, (F.size(f"_t{i}") for i in range(len(arrays))))
    tf = lambda p, weighted: reduce(lambda a, b: a + b, (phrase_count(F.col(f"_t{i}"), list(p)) * (w if weighted else 1) for i, w in enumerate(columns.values())))
    counted = base.select("id", length.alias("dl"), *(tf(p, True).alias(f"tf{i}") for i, p in enumerate(distinct)))
    counted = materialise(counted, "bm25")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(distinct)))).first()
    total = F.lit(0.0)
    n, average = stats["n"], stats["avgdl"] or 1.0
    for p in phrases:
        i = distinct.index(tuple(p))
        df = stats[f"df{i}"]
        idf = F.greatest(F.log(F.lit((n - df + 0.5) / (df + 0.5))), F.lit(IDF_FLOOR)) if n else F.lit(0.0)
        f = F.col(f"tf{i}").cast("double")
        total = total + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / average))
    some = reduce(lambda a, b: a | b, (F.col(f"tf{i}") > 0 for i in range(len(distinct))))
    return counted.filter(some).select("id", total.alias("score"))


def _all_tokens(columns: tuple[str, ...]) -> Column:
    return F.concat(*(T.tokens(F.col(c)) for c in columns))


def postings(rows: DataFrame, id_col: str = "id", columns: tuple[str, ...] = ("content",)) -> DataFrame:
    """The inverted index (term, id, tf, dl), for tables that are searched often; write it sorted by term within files. A text's
    postings are the runs of its sorted tokens, found in its own row (ids differ), so nothing is shuffled."""
    t = rows.select(F.col(id_col).alias("id"), F.sort_array(_all_tokens(columns)).alias("t"))
    opens = F.transform("t", lambda x, i: F.when((i == 0) | (x != F.get(F.col("t"), i - 1)), i))
    p = t.select("id", "t", F.array_compact(opens).alias("p"))
    runs = F.transform("p", lambda i, k: F.struct(F.get(F.col("t"), i).alias("term"), (F.coalesce(F.get(F.col("p"), k + 1), F.size("t")) - i).cast("long").alias("tf")))
    return p.select("id", F.size("t").alias("dl"), F.inline(runs)).select("term", "id", "tf", "dl")


def index_stats(rows: DataFrame, index: DataFrame) -> tuple[int, float]:
    """`lengths` without another pass over the texts: a row's length is the sum of its postings."""
    n, tokens = rows.count(), index.agg(F.sum("tf")).first()[0] or 0
    return n, tokens / n if tokens else 1.0


def lengths(rows: DataFrame, columns: tuple[str, ...] = ("content",)) -> tuple[int, float]:
    """Number of rows and mean number of tokens: what an index needs besides its postings."""
    n, average = rows.agg(F.count("*"), F.avg(F.size(_all_tokens(columns)))).first()
    return n, average or 1.0


def bm25_indexed(index: DataFrame, stats: tuple[int, float], query: str) -> DataFrame:
    """The same score from an index: the filter on term prunes the scan to the query's lists. A term with underscores counts as its parts."""
    terms = [p for t in query_terms(query) for p in re.split("_+", t.lower()) if p]
    if not terms:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    n, average = stats
    weight = F.element_at(F.create_map(*(x for t in set(terms) for x in (F.lit(t), F.lit(terms.count(t))))), F.col("term"))
    hits = index.filter(F.col("term").isin(*set(terms)))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row a query term
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    part = weight * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))
    return hits.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The best k by score, ties by id; TakeOrderedAndProject, so each task sends k rows."""
    return scored.orderBy(*(order or (F.desc("score"), F.col("id")))).limit(k)


def ranked(scored: DataFrame, list_no: int, k: int) -> DataFrame:
    """(id, list_no, rank) of the best k; the window runs over k rows alone."""
    best = top(scored, k)
    return best.select("id", F.lit(list_no).alias("list_no"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))


def cosine_scores(rows: DataFrame, query: list[float], id_col: str = "id", vec_col: str = "embedding", dims: int | None = None) -> DataFrame:
    """(id, score) with score above 0; vectors of other lengths take no part."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.col(vec_col)
    rows = rows.filter(v.isNotNull() & (F.size(v) == len(query)))
    score = V.cosine(V.truncated(v, dims), V.truncated(q, dims)) if dims else V.cosine(v, q)
    return rows.select(F.col(id_col).alias("id"), score.alias("score")).filter("score > 0")


def distance_scores(rows: DataFrame, query: list[float], id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, score): 1 - Euclidean distance."""
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = rows.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) == len(query)))
    gap = F.zip_with(F.col(vec_col), q, lambda a, b: a.cast("double") - b)
    return rows.select(F.col(id_col).alias("id"), (1 - V.norm(gap)).alias("score"))


def code_scores(codes: DataFrame, query: list[float], k: int, bits: int = 4) -> DataFrame:
    """(id, score) of stored codes (id, code4): inner products over all, then cosine of the best max(30, 3k) decoded."""
    few = top(codes.select("id", "code4", V.code_dot(F.col("code4"), query, bits).alias("score")), max(30, 3 * k))
    q = F.array(*(F.lit(float(x)) for x in query))
    return few.select("id", V.cosine(V.dequantize(F.col("code4"), len(query), bits), q).alias("score")).filter("score > 0")


def hamming_scores(rows: DataFrame, query: list[float], id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, distance) over sign codes; Spark's own bit operations."""
    q = V.sign_code(F.array(*(F.lit(float(x)) for x in query)))
    return rows.select(F.col(id_col).alias("id"), V.hamming(V.sign_code(F.col(vec_col)), q).alias("distance"))


def coded(rows: DataFrame, dims: int, id_col: str = "id", vec_col: str = "embedding", bits: int = 4) -> DataFrame:
    """(id, code1, code4): sign bits and packed levels of vectors of that size. A store writes them once; searches read them."""
    fits = rows.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) == dims))
    return fits.select(F.col(id_col).alias("id"), V.sign_code(F.col(vec_col)).alias("code1"), V.quantize(F.col(vec_col), dims, bits).alias("code4"))


def two_stage(rows: DataFrame, query: list[float], k: int, id_col: str = "id", vec_col: str = "embedding", bits: int = 4, codes: DataFrame | None = None) -> DataFrame:
    """4-bit inner products over all rows, then cosine of the decoded best max(30, 3k). Without stored `codes` they are made on the way."""
    return top(code_scores(codes if codes is not None else coded(rows, len(query), id_col, vec_col, bits), query, k, bits), k)


def three_stage(rows: DataFrame, query: list[float], k: int, id_col: str = "id", vec_col: str = "embedding", coarse: int = 1000, middle: int = 50, bits: int = 4, codes: DataFrame | None = None) -> DataFrame:
    """Hamming to `coarse`, 4-bit inner product to `middle`, cosine of the full vectors to k. With stored `codes` the first two read no
    vector; without, only the `coarse` rows are packed."""
    q = F.array(*(F.lit(float(x)) for x in query))
    base = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")) if codes is None else codes.select("id", "code1", "code4")
    sign = V.sign_code(F.col("v")) if codes is None else F.col("code1")
    few = base.withColumn("distance", V.hamming(sign, V.sign_code(q))).orderBy("distance", "id").limit(coarse)
    packed = V.quantize(F.col("v"), len(query), bits) if codes is None else F.col("code4")
    fewer = top(few.select(*(c for c in ("id", "v") if c in few.columns), V.code_dot(packed, query, bits).alias("score")), middle)
    if codes is not None:
        fewer = F.broadcast(fewer.select("id")).join(rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), "id")  # `middle` rows
    return top(fewer.select("id", V.cosine(F.col("v"), q).alias("score")).filter("score > 0"), k)


def top_k_many(rows: DataFrame, queries: DataFrame, k: int, dims: int, query_rows: int = 2048, part_rows: int = 16_384) -> DataFrame:
    """(query_id, id, score, rank): each query's k highest inner products among rows (id, embedding) of other ids, ties to the smaller id.

    Blocks of queries meet parts of rows, both of bounded size, and a meeting leaves k rows a query; a last group limit merges them."""
    blocks = max(1, -(-queries.count() // query_rows))
    parts = max(1, -(-rows.count() // part_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"))
    v = rows.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), every(blocks).alias("block"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.array([np.asarray(x, np.float64) for x in s]).reshape(len(s), dims) for s in (left["q"], right["embedding"]))
        ids, out = right["id"].to_numpy(), []
        for at in range(0, len(a), 64):
            some = a[at : at + 64]
            s = np.zeros((len(some), len(b)))
            for d in range(dims):  # in one order, so that equal vectors tie
                s += some[:, d, None] * b[None, :, d]
            s[left["query_id"].to_numpy()[at : at + 64, None] == ids[None, :]] = -np.inf
            best = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k] if len(b) else np.zeros((len(some), 0), int)
            for i, own in enumerate(best):
                out += [(left["query_id"].iloc[at + i], ids[j], s[i, j]) for j in own if s[i, j] > -np.inf]
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    hits = q.groupBy("block", "part").cogroup(v.groupBy("block", "part")).applyInPandas(meet, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def temporal_scores(rows: DataFrame, query_day: str, limit: int, id_col: str = "id", date_col: str = "event_date") -> DataFrame:
    """exp(-d^2 / 98) over the 3 x limit nearest days, kept at 0.01 or more."""
    d = F.abs(F.datediff(F.col(date_col), F.lit(query_day).cast("date")))
    near = rows.filter(F.col(date_col).isNotNull()).select(F.col(id_col).alias("id"), d.alias("days")).orderBy("days", "id").limit(3 * limit)
    scored = near.select("id", F.exp(-F.pow("days", F.lit(2)) / 98.0).alias("score")).filter("score >= 0.01")
    return top(scored, limit)


def entity_scores(found: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """Different matched values over the number of the query's (type, value) entities."""
    values = sorted({v for _, v in wanted})
    if not values:
        return found.select(F.col("chunk_id").alias("id"), F.lit(0.0).alias("score")).limit(0)
    hits = found.filter(F.col("entity_value").isin(*values))
    return hits.groupBy(F.col("chunk_id").alias("id")).agg((F.count_distinct("entity_value") / F.lit(float(len(wanted)))).alias("score"))


def fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (id, list_no, rank): (id, score, list_no, rank), the last two of the first list that has the id.

    One shuffle by id, pre-aggregated, in place of a chain of outer joins."""
    every = reduce(lambda a, b: a.unionByName(b), lists)
    seen = F.min(F.struct("list_no", "rank"))
    return every.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), seen.alias("s"), F.collect_set("list_no").alias("lists")).select("id", "score", F.col("s.list_no").alias("list_no"), F.col("s.rank").alias("rank"), F.array_sort("lists").alias("lists"))


FUSED = (F.desc, "score")


def fused_order() -> list[Column]:
    """Ties keep the order of lists, then of ranks."""
    return [F.desc("score"), F.col("list_no"), F.col("rank"), F.col("id")]


def hybrid(vector: DataFrame, keyword: DataFrame, k: int, min_score: float = 0.0, pad: bool = True) -> DataFrame:
    """Two-list fusion with match_type; where it gives fewer than k, keyword hits follow at half the last score."""
    a, b = ranked(vector, 0, 4 * k), ranked(keyword, 1, 4 * k)
    fused = fuse([a, b])
    kind = F.when(F.size("lists") == 2, "hybrid").when(F.element_at("lists", 1) == 0, "vector").otherwise("keyword")
    got = fused.filter(F.col("score") >= min_score).withColumn("match_type", kind).orderBy(*fused_order()).limit(k).select("id", "score", "match_type")
    if not pad:
        return got
    last = got.agg(F.min("score").alias("last"), F.count("*").alias("n"))
    spare = b.join(F.broadcast(got.select("id")), "id", "left_anti").crossJoin(F.broadcast(last))  # one row
    more = spare.filter(F.col("n") < k).withColumn("r", F.row_number().over(Window.orderBy("rank"))).filter(F.col("r") <= k - F.col("n"))
    return got.unionByName(more.select("id", (F.coalesce("last", F.lit(0.0)) / 2).alias("score"), F.lit("keyword").alias("match_type")))


# ---- filters after fusion -----------------------------------------------------------------------


def by_source(rows: DataFrame, source: str | None, path: str = "file_path") -> DataFrame:
    return rows.filter(T.source_kind(F.col(path)) == source) if source in ("curated", "conversations", "codebase") else rows


def by_date(rows: DataFrame, after: str | None, before: str | None, date: str = "entry_date") -> DataFrame:
    """Inclusive; a row without a date goes when a bound is set."""
    if after:
        rows = rows.filter(F.col(date) >= F.lit(after).cast("date"))
    if before:
        rows = rows.filter(F.col(date) <= F.lit(before).cast("date"))
    return rows


def by_project(rows: DataFrame, project: str | None, path: str = "file_path", column: str = "project", user: str | None = None) -> DataFrame:
    """Of conversations alone: those whose normalised project holds the argument."""
    if not project:
        return rows
    talks = T.source_kind(F.col(path)) == "conversations"
    return rows.filter(~talks | F.contains(T.normalize_project(F.col(column), user), T.normalize_project(F.lit(project), user)))


def session_cap(rows: DataFrame, cap: int = 2, path: str = "file_path", order: list[Column] | None = None) -> DataFrame:
    """At most `cap` rows of a conversation, in fused order; Spark limits each group before its shuffle."""
    w = Window.partitionBy(path).orderBy(*(order or fused_order()))
    talks = T.source_kind(F.col(path)) == "conversations"
    capped = rows.filter(talks).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")
    return rows.filter(~talks).unionByName(capped)


def boost_by_degree(scored: DataFrame, edges: DataFrame, key: str = "file_path") -> DataFrame:
    """score x (1 + 0.1 ln(1 + in-degree))."""
    degree = edges.filter(F.col("target_file").isNotNull()).groupBy(F.col("target_file").alias(key)).agg(F.count("*").alias("in_degree"))
    got = scored.join(degree, key, "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    return got.withColumn("score", F.col("score") * (1 + F.log1p("in_degree") * 0.1))
