"""Temperature mixing of sources.

Source i holds a share p_i of the tokens and gets the weight p_i^a / Z(a), Z(a) = sum p^a. The exponent a in [0, 1] is bisected: to the
flattest mix whose most repeated source stays within `repeat_limit`, or to the mix with `target_entropy` (nats). Both need but Z(a),
sum p^a ln p and the least and largest share, so a pass over the table of sources answers `LEVELS` halvings at once, and the driver
holds a few numbers however many sources there are; the sums are of decimals, so their order doesn't matter. A budget of T tokens then
gives source i T w_i tokens: whole passes over the source, and a last, partial one. Passes are block permutations: a source's rows
are hashed to blocks, each pass orders the blocks by a hash of its own and a block's rows by theirs; the partial pass takes blocks in
that order while they fit the budget, and rows of the next block while they fit.

There are about as many blocks as the root of the number of rows (`least_blocks` at least), so that neither a source's list of
blocks nor one block's rows, the only things that are ever ordered in one task, pass the root of the table. Sums are pre-aggregated by
(source, block), so a source with a third of all rows is no hot key. Texts are shuffled only where the table of places (a row for
each source and block that are there) passes `broadcast_rows` when counted; its keys are as even as the hash.

Cases. A null source is a source. Null and empty texts have no tokens and go with their block. A source without any
tokens is kept once. Rows that tie in hash, id and tokens are taken together or not at all in the partial block. An empty
table gives an empty result. Extra columns pass through by place, whatever their names; the three added ones are called `names`, and
a column of docs that has such a name stays beside it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.llm import files
from loomdex.runtime import materialise

LEVELS, ROUNDS = 4, 11
#: Rows of the table of sources to a file; a pass over it has so few tasks.
SOURCES_A_FILE = 100_000
NAMES = ("epoch", "block_order", "row_order")


def moments(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(Z(a), sum p^a ln p) of each exponent, in one pass over `shares` (lp: ln p)."""
    exact = lambda x: F.sum(x.cast("decimal(38,18)"))
    power = lambda a: F.exp(F.lit(a) * F.col("lp"))
    row = shares.agg(*(c for a in exponents for c in (exact(power(a)), exact(power(a) * F.col("lp"))))).first()
    return [(float(row[2 * i]), float(row[2 * i + 1])) for i in range(len(exponents))]


def most_repeated(a: float, z: float, least: float, largest: float, total: float, budget: float | str) -> float:
    """Passes over the smallest source: T w / t, with T = total / z of all, or as many as pass every source once."""
    if budget == "cover":
        return math.exp((1 - a) * (largest - least))
    return (total if budget == "all" else float(budget)) / total * math.exp((a - 1) * least) / z


def bisect_exponent(shares: DataFrame, total: float, budget: float | str = "all", repeat_limit: float | None = None, target_entropy: float | None = None) -> tuple[float, float]:
    """(a, Z(a)); both the most repeated source and the entropy fall as the exponent grows."""
    if repeat_limit is None and target_entropy is None:
        raise ValueError("a repetition limit or a target entropy is needed")
    least, largest = shares.agg(F.min("lp"), F.max("lp")).first()

    def beyond(a: float, z: float, s: float) -> bool:
        """Whether a is on the far side: within the limit, or at most the entropy asked for."""
        if repeat_limit is not None:
            return most_repeated(a, z, least, largest, total, budget) <= repeat_limit
        return math.log(z) - a * s / z <= target_entropy

    low, high = 0.0, 1.0
    z, s = moments(shares, [0.0])[0]
    if beyond(0.0, z, s):
        return 0.0, z
    for _ in range(ROUNDS):
        cuts = [low + (high - low) * i / (1 << LEVELS) for i in range(1, 1 << LEVELS)]
        got = dict(zip(cuts, moments(shares, cuts)))
        for _ in range(LEVELS):
            mid = min(got, key=lambda a: abs(a - (low + high) / 2))
            low, high = (low, mid) if beyond(mid, *got[mid]) else (mid, high)
    return high, moments(shares, [high])[0][0]


def words(text: Column) -> Column:
    """Tokens as words between white space."""
    trimmed = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"^\s+", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")) - F.when(trimmed.rlike(r"\s$"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, budget: float | str = "all", repeat_limit: float | None = None, target_entropy: float | None = None, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, least_blocks: int = 1024, seed: int = 17, broadcast_rows: int = 200_000, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """docs' columns plus epoch, block_order, row_order: a row for each copy that the mix holds. Ordering by the three
    realises the permutations. `tokens`: a row's tokens, by default words."""
    blocks = max(least_blocks, 1 << math.isqrt(docs.count()).bit_length())
    columns = [f"c{i}" for i in range(len(docs.columns))]
    count = words(F.col(files.quoted(text_col))) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    base = docs.select("*", count.alias(files.free_name("t", docs.columns))).toDF(*columns, "t")
    col = lambda name: F.col(columns[docs.columns.index(name)])
    source = F.coalesce(col(source_col).cast("string"), F.lit("\0"))
    key = F.xxhash64(F.lit(seed), col(id_col).cast("string"), col(text_col).cast("string"))
    keyed = base.withColumns({"s": source, "h": key, "i": col(id_col).cast("string")}).withColumn("b", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.lit(blocks)).cast("int"))
    narrow = keyed.select("s", "b", "h", "i", "t")
    by_block = materialise(narrow.groupBy("s", "b").agg(F.sum("t").alias("t")), "mix-blocks")

    sources = by_block.groupBy("s").agg(F.sum("t").alias("held"))
    total, n = sources.agg(F.coalesce(F.sum("held"), F.lit(0)), F.count("*")).first()
    log_share = F.when(F.col("held") > 0, F.log(F.col("held") / F.lit(float(max(total, 1)))))
    sources = materialise(sources.withColumn("lp", log_share).coalesce(max(1, n // SOURCES_A_FILE)), "mix-sources")
    near = 1e-9
    if total:
        shares = sources.filter("lp is not null").select("lp")
        a, z = bisect_exponent(shares, float(total), budget, repeat_limit, target_entropy)
        largest = shares.agg(F.max("lp")).first()[0]
        whole = math.exp((1 - a) * largest) * z if budget == "cover" else 1.0 if budget == "all" else float(budget) / total  # the budget, as a share of all tokens
        wanted = F.lit(whole / z) * F.exp(F.lit(a - 1.0) * F.col("lp"))
    else:
        wanted = F.lit(None).cast("double")
    plans = sources.withColumn("wanted", wanted).select(
        "s",
        F.coalesce(F.floor(F.col("wanted") + near).cast("int"), F.lit(1)).alias("passes"),
        F.coalesce(F.greatest(F.lit(0.0), (F.col("wanted") - F.floor(F.col("wanted") + near)) * F.col("held")), F.lit(0.0)).alias("rest"),
    )
    few = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df

    order = lambda epoch: F.xxhash64(F.lit(seed + 2), F.col("s"), epoch.cast("int"), F.col("b"))
    w = Window.partitionBy("s").orderBy("o", "b")  # at most `blocks` rows a source
    placed = by_block.join(few(plans), "s").withColumn("o", order(F.col("passes") + 1)).withColumn("upto", F.sum("t").over(w))
    placed = placed.withColumn("more", (F.col("rest") > 0) & (F.col("upto") <= F.col("rest") + near))
    cut = F.min(F.when(~F.col("more") & (F.col("rest") > 0), F.struct("o", "b"))).over(Window.partitionBy("s"))
    placed = placed.withColumn("edge", F.coalesce((F.struct("o", "b") == cut), F.lit(False)))
    placed = materialise(placed.select("s", "b", "passes", F.col("more").cast("int").alias("more"), "edge", F.when(F.col("edge"), F.col("rest") - F.col("upto") + F.col("t")).alias("left")), "mix-places")

    inside = narrow.join(few(placed.filter("edge").select("s", "b", "left")), ["s", "b"])  # a row a source
    ties = Window.partitionBy("s").orderBy("h", "i", "t")  # a range frame: rows that tie share their sum
    upto = inside.withColumn("upto", F.sum("t").over(ties)).filter(F.col("upto") <= F.col("left") + near)
    limits = materialise(upto.groupBy("s").agg(F.max(F.struct("h", F.coalesce("i", F.lit("")).alias("i"), "t")).alias("last")), "mix-limits")
    table = materialise(placed.drop("left").join(few(limits), "s", "left"), "mix-table")

    joined = keyed.join(few(table), ["s", "b"])
    within = F.col("edge") & F.coalesce(F.struct("h", F.coalesce("i", F.lit("")).alias("i"), "t") <= F.col("last"), F.lit(False))
    copies = F.col("passes") + F.when((F.col("more") == 1) | within, 1).otherwise(0)
    dealt = joined.withColumn("epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    return dealt.select(*columns, "epoch", order(F.col("epoch")).alias("block_order"), F.col("h").alias("row_order")).toDF(*docs.columns, *names)


def op6_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens' budget, at the flattest mix that repeats no source more than twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    got = mix(docs, budget="all", repeat_limit=2.0)
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("n_tokens"), "epoch", "block_order", "row_order")
