import random

import corpus_pipeline as P
from pyspark.sql import functions as F

from loomdex.llm import files, secrets
from loomdex.llm.jaccard_join import similar_sets


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        path = f"file://{tmp_path}/{i}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name != "pieces":
            assert docs.columns == columns
        if name == "quality":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            gone = before.join(docs, "doc_id", "left_anti").join(labels, "doc_id")
            good = before.join(labels, "doc_id").filter("quality = 1").count()
            assert gone.filter("quality = 1").count() <= 0.05 * good and gone.filter("quality = 0").count() >= 0.9 * before.join(labels, "doc_id").filter("quality = 0").count()
        elif name == "near_duplicates":
            classes = similar_sets(before)
            assert {r["doc_id"] for r in docs.collect()} == {r["component_id"] for r in classes.collect()}
        elif name == "secrets":
            assert docs.count() == before.count()
            assert not [r for r in secrets.scan(docs, path="doc_id")[1].collect() if any(f["rule"] in secrets.BASE for f in r["findings"])]
            assert docs.filter(F.length("text") != F.col("n_chars")).count() == before.filter(F.length("text") != F.col("n_chars")).count()
        elif name == "mixing":
            assert docs.select("doc_id").distinct().count() == before.count()
            assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert docs.count() == before.count() and docs.filter("not lossless").count() == 0


CLASH = "doc_id long, text string, lang string, source string, n_chars int, score double, `_score` string, blob string, findings int, key_id int, a int, b int, `class` int, epoch int, block_order int, t int, s int, `od``d. name` string"


def table(spark, rows):
    """Rows of (doc_id, text), with columns whose names the stages use themselves."""
    return spark.createDataFrame([(i, t, "en", "x", len(t or ""), 0.5, "u", "v", 1, 2, 3, 4, 5, 6, 7, 8, 9, "w") for i, t in rows], CLASH)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def test_clashing_names_repeated_and_null_ids_and_empty_tables(spark, sf, tmp_path):
    rng = random.Random(1)
    one, two, three = (words(rng, 60) for _ in range(3))
    near = two.rsplit(" ", 2)[0] + " xx yy"
    rows = [(3, one), (5, one), (5, two), (7, near), (7, near), (None, one), (None, three), (None, three), (9, ""), (9, ""), (9, None), (1, " \n"), (5, "password=12345678 " + words(rng, 20))]
    docs = table(spark, rows)
    for name, stage in P.STAGES[1:]:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, sf)
            out.write.mode("overwrite").parquet(f"file://{tmp_path}/{name}")
            if name != "pieces":
                assert out.columns == docs.columns
            if d is not docs:
                assert out.count() == 0
    kept = sorted(((r["doc_id"], r["text"]) for r in P.one_of_each(spark, docs, sf).collect()), key=repr)
    assert kept == sorted([(3, one), (5, two), (None, three), (9, ""), (9, ""), (9, None), (1, " \n"), rows[-1]], key=repr)
    clean = {r["text"]: r["n_chars"] for r in P.without_secrets(spark, docs, sf).collect()}
    assert rows[-1][1] not in clean and all(n == len(t or "") for t, n in clean.items()) and len(P.mixed(spark, docs, sf).collect()) >= len(rows)
    documents = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"score": F.lit("mine"), "_score": F.lit(1), "c0": F.lit(2)})
    got = P.good_quality(spark, documents, sf)
    assert got.columns == documents.columns and got.filter("score = 'mine'").count() == got.count() > 0
    assert P.good_quality(spark, documents.limit(0), sf).count() == 0


def test_one_of_each_equals_brute_force(spark, sf):
    """Ids and texts repeat at will; classes by plain comparison of shingle sets."""
    from test_jaccard_join import brute, corpus

    rng = random.Random(3)
    texts = corpus(rng)
    texts += rng.choices(texts, k=60)
    ids = [rng.choice([None, *range(40)]) for _ in texts]
    classes = [c for _, c in brute(texts)]
    sizes = [n for n, _ in brute(texts)]
    got = P.one_of_each(spark, table(spark, list(zip(ids, texts))).repartition(3), sf).collect()
    plain = sorted((repr((i, t)) for i, t, n in zip(ids, texts, sizes) if not n))
    assert sorted(repr((r["doc_id"], r["text"])) for r in got if not (r["text"] or "").strip()) == plain
    of_text = dict(zip(texts, classes))
    kept = [(of_text[r["text"]], r["doc_id"]) for r in got if (r["text"] or "").strip()]
    least = {}
    for i, c, n in zip(ids, classes, sizes):
        if n:
            least.setdefault(c, []).append(i)
    assert sorted(map(repr, kept)) == sorted(repr((c, min((i for i in x if i is not None), default=None))) for c, x in least.items())


def test_the_driver_returns_freed_memory_before_each_stage(spark, sf, monkeypatch):
    """Native memory that is freed stays in the JVM's arenas, and free heap stays with it, until the driver gives them back."""
    jvm = spark.sparkContext._jvm
    status = f"/proc/{jvm.java.io.File('/proc/self').getCanonicalFile().getName()}/status"
    held_mb = lambda: next(int(x.split()[1]) / 1024 for x in open(status) if x.startswith("RssAnon"))
    give_back, fell = files.driver_gives_back, []

    def measured(session):
        native = [jvm.java.util.zip.Deflater() for _ in range(600)]
        for x in native[:-1]:  # the last one keeps the arena's top
            x.end()
        before = held_mb()
        give_back(session)
        fell.append(before - held_mb())
        native[-1].end()

    monkeypatch.setattr(files, "driver_gives_back", measured)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        done = len(fell)
        stage(spark, docs, sf)
        assert len(fell) > done and min(fell[done:]) > 20
