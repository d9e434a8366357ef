import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from loomdex.llm import pii as P

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    return sum((d := int(c) * (1 + i % 2)) - 9 * (d > 9) for i, c in enumerate(reversed(s))) % 10 == 0


def base(s):
    n = lambda m: len(re.sub("[^0-9]", "", m.group()))
    out = [("email", *m.span()) for m in EMAIL.finditer(s)]
    out += [("ip", *m.span()) for m in IP.finditer(s) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(s) if 16 <= n(m) <= 19 and luhn(re.sub("[^0-9]", "", m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(s) if 8 <= n(m) <= 15]


def test_base_spans_equal_plain_search(spark, docs, odd, fit):
    rng = random.Random(3)
    bits = ["a@b.c_d@e.f", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.255", "4041894974608795", "4041 8949-7460 8795", "4041894974608795 27.65.93.188", "+1 (988) 555-2485", "+1 2", "++12345678", "@@", "..", "a..b@c-d.e--f.g", "é@x.y", "\U0001f600", " ", "-", "12", "Zz%+._-@A.B"]
    texts = odd + ["".join(rng.choice(bits) + rng.choice(["", " ", ".", "\n"]) for _ in range(8)) for _ in range(200)] + ["9" * 5000, "a." * 4000 + "@", "+1" + " 2" * 3000]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for r in P.find(docs(texts), fit=fit).collect()}
    for i, t in enumerate(texts):
        assert got[i] == base(t or ""), t[:200]


@pytest.fixture(scope="module")
def fit(spark, sf):
    return P.fitted(spark.read.parquet(f"{sf}/documents.parquet"))


def test_held_out_precision_and_recall(fit):
    for f in fit[2]:
        assert f["rows"] >= 30 and f["precision"] >= 0.95 and f["recall"] >= 0.9, f


ADDED = [
    ("please contact: ann.lee [at] example [dot] com today", ["email_spelled"]),
    ("call me at (988) 555-2485 ok", ["phone_local"]),
    ("tel. 06 12 34 56 78, or so", ["phone_local"]),
    ("phone 030 1234567 ok", ["phone_local"]),
    ("my card 4041894974608795 27 was", ["card_close"]),
    ("my card 4041894974608796 27 was", []),
    ("social 536-22-1234 of", ["social"]),
    ("account DE89 3704 0044 0532 0130 00 thanks", ["account"]),
    ("serial DE88 3704 0044 0532 0130 00 thanks", []),
    ("order 12 of 1999-2004 and version 3.10", []),
    ("on 2024-01-05 the garden was green and quiet", []),
    ("", []),
    (None, []),
]


def test_added_spans(spark, docs, fit):
    got = {r["doc_id"]: [s["kind"] for s in r["added"]] for r in P.find(docs([t for t, _ in ADDED]), fit=fit).collect()}
    for i, (t, want) in enumerate(ADDED):
        assert got[i] == want, t
    assert P.find(docs([]), fit=fit).count() == 0


def test_fits_without_documents(spark, docs):
    models, thresholds, _ = P.fitted(docs([]))
    assert all(m[1] for m in models) and len(models) == len(thresholds) == len(P.GENERATORS)


def plain_choice(base, scored):
    """Best first over all spans at once."""
    kept = []
    for score, start, rank, end in sorted((-s, a, r, b) for r, a, b, s in scored):
        if all(e <= start or end <= a for a, e in [*base, *((x, y) for _, x, y in kept)]):
            kept.append((rank, start, end))
    return sorted(kept)


def test_choice_equals_a_plain_loop(spark, docs, fit):
    """Every added span of texts full of overlapping candidates, from the candidates' own features."""
    rng = random.Random(8)
    bits = ["(988) 555-2485", "4041894974608795", "12 34 56 78", "536-22-1234", "DE89 3704 0044 0532 0130 00", "+1 (603) 555-8791", "a@b.org", "1.2.3.4", "ann [at] x.org", "call ", "my card ", "order ", " ", ", ", "2024-01-05", "\U0001f600"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " and "]) for _ in range(rng.randint(5, 120))) for _ in range(60)]
    d = docs(texts)
    seen = {r["doc_id"]: r["c"] for r in d.select("doc_id", P.candidates(F.col("text")).alias("c")).collect()}
    models, thresholds, _ = fit
    for r in P.find(d, fit=fit).collect():
        c = seen[r["doc_id"]]
        x = np.array([[x[f] for f in P.FEATURES] for x in c]).reshape(-1, len(P.FEATURES))
        score = [float(P.evaluate(models[y["rank"]], x[i : i + 1])[0]) for i, y in enumerate(c)]
        scored = [(y["rank"], y["start"], y["end"], s) for y, s in zip(c, score) if s >= thresholds[y["rank"]]]
        want = plain_choice([(b["start"], b["end"]) for b in r["base"]], [(a, b, e, round(s, 9)) for a, b, e, s in scored])
        assert [(s["rank"] - len(P.BASE), s["start"], s["end"]) for s in r["added"]] == want
    chain = [(0, 0, 10, 3.0), (0, 8, 20, 2.0), (0, 18, 30, 1.0)]
    assert plain_choice([], chain) == [(0, 0, 10), (0, 18, 30)]


def test_candidates_equal_plain_search(spark, docs, odd):
    texts = [t for t in odd if t] + [t for t, _ in ADDED if t]
    for r in docs(texts).select("text", P.candidates(F.col("text")).alias("c")).collect():
        for rank, pattern in enumerate(P.GENERATORS.values()):
            plain = [m.span() for m in regex.finditer(pattern, r["text"], flags=regex.V0)]
            assert [(c["start"], c["end"]) for c in r["c"] if c["rank"] == rank] == plain


def test_boosting_learns():
    x = np.random.RandomState(0).rand(600, 4)
    y = ((x[:, 0] > 0.5) & (x[:, 2] > 0.3)).astype(float)
    score = P.evaluate(P.boost(x[:400], y[:400]), x[400:])
    assert ((score > 0) == (y[400:] > 0)).mean() > 0.95
