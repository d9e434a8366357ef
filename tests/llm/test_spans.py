import random
import re
import time

from pyspark.sql import functions as F

from loomdex.llm import pii, secrets
from loomdex.llm import spans as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_running_totals(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 63, 64, 65, 500):
        v = [rng.randrange(9) for _ in range(n)]
        row = spark.createDataFrame([(v,)], "v array<int>").select(S.running(F.col("v"), lambda a, b: a + b).alias("s"), S.running(F.col("v"), lambda a, b: F.greatest(a, b)).alias("m")).first()
        assert row["s"] == [sum(v[: i + 1]) for i in range(n)] and row["m"] == [max(v[: i + 1]) for i in range(n)]


def test_cuts_equal_slices(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("aé😀\n\r ") for _ in range(3 * S.BLOCK + 17))
    places = [(rng.randrange(-5, len(text)), rng.randrange(0, len(text) + 9)) for _ in range(200)] + [(0, len(text)), (S.BLOCK, 2 * S.BLOCK), (S.BLOCK - 1, S.BLOCK), (0, S.BLOCK), (0, 0)]
    got = spark.createDataFrame([(text, places)], "t string, p array<struct<a:int,b:int>>").select(S.let(S.blocks(F.col("t")), lambda b: F.transform("p", lambda x: S.cut(b, x["a"], x["b"]))).alias("x")).first()["x"]
    assert got == [text[max(a, 0) : b] if b > max(a, 0) else "" for a, b in places]


def test_matches_equal_plain_search(spark):
    rng = random.Random(3)
    for pattern in (r"[ab]+", r"\d{2}", "é."):
        for n in (0, 5, 3000):
            t = "".join(rng.choice("ab1é 😀x") for _ in range(n))
            assert [tuple(r) for r in one(spark, S.matches(F.col("t"), pattern), t=t)] == [(*m.span(), m.group()) for m in re.finditer(pattern, t)]


def test_clusters(spark):
    rng = random.Random(4)
    spans = [(a, a + rng.randint(1, 12)) for a in (rng.randrange(900) for _ in range(150))]
    want = []
    for s in sorted(spans):
        if want and s[0] < max(e for _, e in want[-1]):
            want[-1].append(s)
        else:
            want.append([s])
    got = spark.createDataFrame([(spans,)], "s array<struct<start:int,end:int>>").select(S.clusters(F.col("s")).alias("x")).first()["x"]
    assert [[tuple(y) for y in c] for c in got] == want


def seconds(spark, column, text):
    df = spark.createDataFrame([(text,)], "t string").select(column.alias("x"))
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_many_matches_cost_in_proportion(spark):
    """Forty times the matches: within about twice the time a match."""
    found = S.spans(F.col("t"), pii.EMAIL, hint="@")
    mail = "x@y.org and then some more "
    keys = "token = abcdefgh12 and "
    whole = secrets.redacted(F.col("t"), F.transform(secrets.RULES["assign"][1](F.col("t")), lambda s: F.struct(F.lit("a").alias("rule"), s["start"].alias("start"), s["end"].alias("end"))))
    for column, unit in ((found, mail), (whole, keys)):
        seconds(spark, column, unit * 1000)
        few = min(seconds(spark, column, unit * 1000) for _ in range(3))
        assert seconds(spark, column, unit * 40_000) < 2.5 * 40 * max(few, 0.05)
