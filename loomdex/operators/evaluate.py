"""Retrieval quality: recall by category, comparison with saved figures, and the summarise-judge-refine loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions import text as T
from loomdex.operators import segment as S
from loomdex.runtime import materialise


def recall(results: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """results (query_id, id, rank), relevant (query_id, category, ids): category, queries, r5, r10; means rounded to three places, the
    overall one being the query-weighted mean of the rounded ones."""
    found = results.groupBy("query_id").agg(*(F.collect_set(F.when(F.col("rank") <= k, F.col("id"))).alias(f"f{k}") for k in ks))
    each = relevant.join(found, "query_id", "left").select("category", *(F.coalesce(F.size(F.array_intersect(F.coalesce(f"f{k}", F.array().cast("array<string>")), "ids")), F.lit(0)) / F.size("ids") for k in ks))
    each = each.toDF("category", *(f"v{k}" for k in ks))
    by = each.groupBy("category").agg(F.count("*").alias("queries"), *(F.round(F.avg(f"v{k}"), 3).alias(f"r{k}") for k in ks))
    overall = by.agg(F.sum("queries").alias("queries"), *(F.round(F.sum(F.col(f"r{k}") * F.col("queries")) / F.sum("queries"), 3).alias(f"r{k}") for k in ks))
    return by.unionByName(overall.withColumn("category", F.lit("overall")))


def compared(now: DataFrame, saved: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    other = saved.select("category", *(F.col(f"r{k}").alias(f"s{k}") for k in ks))
    return now.join(other, "category", "left").select(*now.columns, *(F.round(F.col(f"r{k}") - F.col(f"s{k}"), 3).alias(f"d{k}") for k in ks))


def refined(rows: DataFrame, summarise: Callable[[Column], Column], judge: Callable[[Column, Column], Column], improve: Callable[[Column, Column, Column], Column], threshold: float = 8.0, most: int = 2, text: str = "transcript") -> DataFrame:
    """summary, score, rounds: rows below the threshold are improved by the judge's feedback and judged again; the best stays."""
    x = rows.withColumn("summary", summarise(F.col(text)))
    x = x.withColumn("verdict", judge(F.col(text), F.col("summary")))
    x = materialise(x.withColumns({"score": T.judge_score(F.col("verdict")), "rounds": F.lit(0)}), "summaries")
    for i in range(1, most + 1):
        low = F.coalesce("score", F.lit(0.0)) < threshold
        new = F.when(low, improve(F.col(text), F.col("summary"), T.judge_feedback(F.col("verdict"))))
        y = x.withColumn("new", new).withColumn("new_verdict", F.when(low, judge(F.col(text), F.col("new")))).withColumn("new_score", T.judge_score(F.col("new_verdict")))
        better = low & (F.coalesce("new_score", F.lit(-1.0)) > F.coalesce("score", F.lit(-1.0)))
        x = materialise(y.select(*rows.columns, F.when(better, F.col("new")).otherwise(F.col("summary")).alias("summary"), F.when(better, F.col("new_verdict")).otherwise(F.col("verdict")).alias("verdict"), F.when(better, F.col("new_score")).otherwise(F.col("score")).alias("score"), F.when(low, F.lit(i)).otherwise(F.col("rounds")).alias("rounds")), "summaries")
    return x.drop("verdict")


def scored_window(rows: DataFrame, scorer: Callable[[list[str]], list[float] | None], window: int = 16, least: int = 3) -> DataFrame:
    """The scorer's check: each conversation's first window of exchanges, scored once: (conv_id, boundary from 0, score, label, preview).
    Conversations of fewer than `least` exchanges have no rows; a window without scores has zeros."""
    w = Window.partitionBy("conv_id")
    first = rows.withColumns({"n": F.count("*").over(w), "at": F.row_number().over(w.orderBy("exchange"))}).filter(F.col("n").between(least, 1 << 30) & (F.col("at") <= window))
    numbered = first.select("conv_id", F.col("at").cast("long").alias("exchange"), "user", "assistant")
    got = S.window_scores(numbered, scorer, (window,)).join(numbered, ["conv_id", "exchange"])
    score = F.coalesce("score", F.lit(0.0))
    names = F.array(*map(F.lit, ("no break", "weak", "moderate", "strong")))
    return got.select("conv_id", (F.col("exchange") - 2).alias("boundary"), score.alias("score"), F.get(names, F.bround(score).cast("int")).alias("label"), F.substr("user", F.lit(1), F.lit(60)).alias("preview"))


def score_summary(scored: DataFrame) -> DataFrame:
    """Mean score, and how many breaks are strong (2.5 or more), moderate (1.5), weak (.5) or none."""
    s = F.col("score")
    return scored.groupBy("conv_id").agg(F.round(F.avg(s), 2).alias("mean"), F.count_if(s >= 2.5).alias("strong"), F.count_if((s >= 1.5) & (s < 2.5)).alias("moderate"), F.count_if((s >= 0.5) & (s < 1.5)).alias("weak"), F.count_if(s < 0.5).alias("none"))
