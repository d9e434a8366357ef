import math
import random

import pytest
from pyspark.sql import functions as F

from loomdex.llm import mixing as M


def weights(tokens, a):
    total = sum(tokens.values())
    powers = {s: (t / total) ** a for s, t in tokens.items() if t > 0}
    return {s: x / sum(powers.values()) for s, x in powers.items()}


def repeats(tokens, a, budget):
    w = weights(tokens, a)
    whole = max(tokens[s] / x for s, x in w.items()) if budget == "cover" else sum(tokens.values()) if budget == "all" else budget
    return {s: whole * x / tokens[s] for s, x in w.items()}


def exponent(tokens, fine):
    """The least exponent in [0, 1] that is fine, by plain halving."""
    low, high = 0.0, 1.0
    if fine(low):
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fine(mid) else (mid, high)
    return high


def shares(spark, tokens):
    total = sum(tokens.values())
    return spark.createDataFrame([(math.log(t / total),) for t in tokens.values()], "lp double")


def test_exponent(spark):
    entropy = lambda w: -sum(x * math.log(x) for x in w.values())
    for tokens in ({"a": 1000, "b": 100, "c": 10}, {f"h{i}": 3 + i * i for i in range(300)}):
        lp, total = shares(spark, tokens), float(sum(tokens.values()))
        for budget, limit in (("all", 1.5), ("all", 4.0), ("cover", 2.0), (500, 1.2)):
            a, z = M.bisect_exponent(lp, total, budget, repeat_limit=limit)
            assert abs(a - exponent(tokens, lambda x: max(repeats(tokens, x, budget).values()) <= limit)) < 1e-9
            assert abs(z - sum((t / total) ** a for t in tokens.values())) < 1e-9
        a, _ = M.bisect_exponent(lp, total, target_entropy=0.9)
        assert abs(a - exponent(tokens, lambda x: entropy(weights(tokens, x)) <= 0.9)) < 1e-9
    assert M.bisect_exponent(lp, total, target_entropy=99.0)[0] == 0.0
    with pytest.raises(ValueError):
        M.bisect_exponent(lp, total)


def corpus():
    rng = random.Random(2)
    return [("w " * rng.randint(1, 30), rng.choice("aaaaaabbc")) for _ in range(900)]


def plain_mix(spark, data, budget, limit, blocks, seed=17):
    """The copies (doc_id, epoch) that the permutations give, by one loop over each source's blocks and rows."""
    key = F.xxhash64(F.lit(seed), F.col("i").cast("string"), F.col("t"))
    rows = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(data)], "i long, t string, s string").select("i", "t", "s", key.alias("h")).withColumn("b", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.lit(blocks)).cast("int")).collect()
    tokens = {}
    for r in rows:
        tokens[r["s"]] = tokens.get(r["s"], 0) + len(r["t"].split())
    a = exponent(tokens, lambda x: max(repeats(tokens, x, budget).values()) <= limit)
    out = set()
    for s, want in repeats(tokens, a, budget).items():
        own, whole = [r for r in rows if r["s"] == s], math.floor(want + 1e-9)
        out |= {(r["i"], e) for r in own for e in range(1, whole + 1)}
        left = (want - whole) * tokens[s]
        place = {r["b"]: r["o"] for r in spark.range(blocks).select(F.col("id").cast("int").alias("b")).withColumn("o", F.xxhash64(F.lit(seed + 2), F.lit(s), F.lit(whole + 1), "b")).collect()}
        for b in sorted({r["b"] for r in own}, key=place.__getitem__):
            block = sorted((r for r in own if r["b"] == b), key=lambda r: (r["h"], str(r["i"])))
            size = sum(len(r["t"].split()) for r in block)
            if size <= left + 1e-9:
                out |= {(r["i"], whole + 1) for r in block}
                left -= size
                continue
            for r in block:
                left -= len(r["t"].split())
                if left < -1e-9:
                    break
                out.add((r["i"], whole + 1))
            break
    return out


@pytest.mark.parametrize("budget, limit", [("all", 2.0), ("cover", 2.0), (3000, 1.5)])
def test_copies_equal_a_plain_loop(spark, docs, budget, limit):
    data = corpus()
    d = docs([t for t, _ in data], sources=[s for _, s in data])
    want = plain_mix(spark, data, budget, limit, 64)
    for broadcast_rows in (200_000, 0):
        got = M.mix(d, budget, repeat_limit=limit, least_blocks=64, broadcast_rows=broadcast_rows)
        assert sorted((r["doc_id"], r["epoch"]) for r in got.collect()) == sorted(want)
    once = got.filter("epoch = 1 and source = 'a'").orderBy("epoch", "block_order", "row_order").collect()
    assert [r["row_order"] for r in once] != sorted(r["row_order"] for r in once)  # blocks first, then rows


def test_odd_rows_and_clashing_names(spark, docs, odd):
    d = docs(odd, sources=[None, "e", "e", *["a"] * (len(odd) - 3)]).withColumns({"epoch": F.lit("own"), "t": F.lit(1), "s": F.lit(2), "Block_Order": F.lit(3)})
    got = M.mix(d, "cover", repeat_limit=3.0, names=("e2", "b2", "r2"))
    assert got.columns == [*d.columns, "e2", "b2", "r2"]
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == set(range(len(odd))) and {(r["epoch"], r["t"], r["s"]) for r in rows} == {("own", 1, 2)}
    assert M.mix(docs([]), repeat_limit=2.0).count() == 0
    assert M.mix(docs(["", None]), repeat_limit=2.0).count() == 2
    words = {r["doc_id"]: r["n"] for r in docs(odd).select("doc_id", M.words(F.col("text")).alias("n")).collect()}
    assert words[0] == words[1] == words[2] == 0 and words[4] == 1 and words[11] == 3000
