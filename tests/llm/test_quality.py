import random

from pyspark.sql import functions as F

from loomdex.llm import quality as Q


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    words = ["river", "stone", "window", "paper", "green", "quiet", "letter", "garden", "summer", "bread"]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(60)]
        bad = i % 4 == 0
        rows.append((i, (" ".join(x.upper() + "!!" for x in w) if i % 8 else " ".join([w[0]] * 60)) if bad else " ".join(w) + ".", 0 if bad else 1))
    return rows


def test_held_out_accuracy_and_odd_rows(spark, docs, odd):
    """`docs` has a column of the score's name, which stays beside it."""
    rows = corpus()
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    d = docs([t for _, t, _ in rows])
    model = Q.fit(d, labels, fit_rows=200)
    scored = Q.score(d, model, d.columns, out="s")
    assert scored.columns == [*d.columns, "s"]
    got = {r["doc_id"]: r["s"] for r in scored.collect()}
    held = {r["doc_id"] for r in d.filter(~Q.in_training(F.col("doc_id"))).collect()}
    assert len(held) > 20
    right = sum((got[i] >= 0.3) == (q == 1) for i, _, q in rows if i in held)
    assert right / len(held) >= 0.95
    strange = {r["doc_id"]: r["score"] for r in Q.score(docs(odd), model, ["doc_id"], slice_bytes=500).collect()}
    assert len(strange) == len(odd) and all(0 <= s <= 1 for s in strange.values())
    assert strange[0] == strange[1] == strange[2] and strange[8] == strange[9]
    assert Q.score(docs([]), model, ["doc_id", "score"], out="x").count() == 0


def test_shares_of_labels_correct_the_odds(spark, docs):
    """Texts that say nothing of their label get about the share of label 1."""
    rng = random.Random(4)
    words = ["river", "stone", "paper", "green", "quiet", "letter"]
    texts = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(2000)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(2000)], "doc_id long, quality int")
    model = Q.fit(docs(texts), labels, fit_rows=300)
    got = [r["score"] for r in Q.score(docs(texts), model, ["doc_id"]).collect()]
    assert 0.8 < sum(got) / len(got) < 0.97


def test_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.fit(docs(["a", "b"]), labels)
    assert [r["score"] for r in Q.score(docs(["a", None]), model, ["doc_id"]).collect()] == [0.5, 0.5]


def test_long_labelled_texts_are_fitted(spark, docs):
    """All of label 0 is longer than any slice: a fit without them would know one label only."""
    texts = [("noise " * 30_000 if i % 2 else "river stone paper green") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)], "doc_id long, quality int")
    model = Q.fit(docs(texts), labels, slice_bytes=1000)
    got = {r["doc_id"]: r["score"] for r in Q.score(docs(texts), model, ["doc_id"]).collect()}
    assert min(got[i] for i in range(0, 60, 2)) > max(got[i] for i in range(1, 60, 2))


def test_equal_texts_score_equally_in_any_slice(spark, docs):
    rng = random.Random(9)
    rows = corpus(60)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = Q.fit(docs([t for _, t, _ in rows]), labels)
    long = " ".join(rng.choice(["river", "Stone!", "x9", "paper,", "été"]) for _ in range(9000))
    texts = []
    for i in range(40):
        texts += [" ".join(rng.choice(["a", "bb", "Cc."]) for _ in range(rng.randint(0, 900))), long, "same text, twice"]
    got = [[r["score"] for r in Q.score(docs(texts), model, ["doc_id"], slice_bytes=s).orderBy("doc_id").collect()] for s in (200, 70_000, 1 << 22)]
    assert got[0] == got[1] == got[2]
    assert len(set(got[0][1::3])) == 1 and len(set(got[0][2::3])) == 1
