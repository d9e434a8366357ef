"""From documents to token ids: five stages, each by one operator of loomdex.llm.

Each stage reads what the one before it wrote as Parquet, works on all of it, and returns all columns of documents (the last
one returns ids instead).

Cases, for every stage but where said: null and empty texts stay (an empty text is scored like any other, so `quality` may drop it);
rows are rows, so repeated ones are treated alike and each is kept or dropped on its own, but for `near_duplicates`, which keeps one
of exact repeats; a null doc_id is a value like others and comes last among ids; very long texts are read whole; an empty table gives an
empty table; a column of any name passes through, as working columns take names that are free. Memory: before a stage, and once it has
its classes, the driver returns what the jobs so far have freed, as a long session's jobs would otherwise add up. Ties: `near_duplicates` keeps the
smallest (doc_id, hash of text); `mixing` takes rows that tie together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import files, jaccard_join, mixing, piece_codec, quality, secrets
from loomdex.runtime import materialise, on_workers, shared_path

#: Up to so many rows of a fixed width are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
KEYS = ("doc_id", "a", "b")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _only(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.col(files.quoted(c)) for c in columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more stay."""
    files.driver_gives_back(spark)
    model = quality.fit(docs, on_workers(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    score = files.free_name("score", docs.columns)
    return _only(quality.score(docs, model, docs.columns, out=score).filter(F.col(score) >= 0.3), docs.columns)


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with its row key beside it: the id and 128 bits of hash of the text."""
    names = [files.free_name(k, docs.columns) for k in ("key_id", "key_a", "key_b")]
    text = F.col("text").cast("string")
    return docs.withColumns(dict(zip(names, (F.col("doc_id").cast("long"), F.xxhash64(text), F.xxhash64(F.lit(1), text))))), names


def _same(left: list[str], right: DataFrame):
    """Rows of equal keys, nulls equal; the right side's columns are KEYS."""
    return [F.col(files.quoted(x)).eqNullSafe(right[k]) for x, k in zip(left, KEYS)]


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, Jaccard 0.75) one document stays: the one with the smallest id, of equal ids
    that with the smallest hash of text, of exact repeats any one. Rows that share an id but no text are different documents. Texts without
    words have no class, and each row of them stays."""
    files.driver_gives_back(spark)
    keyed, names = _keyed(docs)
    rows = keyed.select(*(F.col(n).alias(k) for n, k in zip(names, KEYS)), F.col("text").cast("string").alias("text"))
    found = materialise(jaccard_join.set_classes(rows, list(KEYS)).filter("n > 0").groupBy("class", *KEYS).agg(F.count("*").alias("rows")), "classes")
    files.driver_gives_back(spark)
    first = materialise(found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), *KEYS)).alias("best")), "first")
    marked = found.join(_small(first), "class").withColumn("stays", F.struct(*KEYS).eqNullSafe(F.struct(*(F.col(f"best.{k}").alias(k) for k in KEYS))))
    marked = materialise(marked.filter(~F.col("stays") | (F.col("rows") > 1)).select(*KEYS, "stays"), "removed")
    gone, repeated = (marked.filter(x).select(*KEYS) for x in ("not stays", "stays"))
    left = keyed.join(_small(gone), _same(names, gone), "left_anti")
    if repeated.isEmpty():
        return _only(left, docs.columns)
    repeated = _small(repeated)
    rest = left.join(repeated, _same(names, repeated), "left_anti")
    some = left.join(repeated, _same(names, repeated), "left_semi").groupBy(*(F.col(n).alias(k) for n, k in zip(names, KEYS))).agg(F.first(F.struct(*(F.col(files.quoted(c)) for c in docs.columns))).alias("row"))
    return _only(rest, docs.columns).unionByName(some.select("row.*"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Findings are cut out of texts; n_chars follows."""
    files.driver_gives_back(spark)
    blob, findings = (files.free_name(n, docs.columns) for n in ("blob", "findings"))
    _, found = secrets.scan_blobs(docs)
    found = materialise(found.withColumnsRenamed({"blob": blob, "findings": findings}), "findings")
    rows = docs.withColumn(blob, secrets.address(F.col("text"))).join(_small(found), blob, "left")
    hit = F.col(findings).isNotNull()
    text = F.when(hit, secrets.redacted(F.col("text"), F.col(findings))).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(files.quoted(c)) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The flattest mix that passes every source at least once and none more than twice; no document is lost."""
    files.driver_gives_back(spark)
    names = tuple(files.free_name(n, docs.columns) for n in mixing.NAMES)
    return _only(mixing.mix(docs, budget="cover", repeat_limit=2.0, names=names), docs.columns)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_crc32, lossless, ids."""
    files.driver_gives_back(spark)
    import public_tokenizers

    return piece_codec.encode_docs(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "lang", "source"])


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("pieces", piece_ids),
]

#: No SQL can express the trained classifier or the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_workers(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = shared_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
