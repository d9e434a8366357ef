"""Jobs put together from operators: indexing, maintenance, checks and migration. Each takes and returns DataFrames, or writes a
versioned table."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import entities as E
from loomdex.functions import text as T
from loomdex.functions import vectors as V
from loomdex.operators import code as C
from loomdex.operators import graph as G
from loomdex.operators import retrieve as R
from loomdex.operators import segment as S
from loomdex.sources import scan
from loomdex.streaming import jobs as J

DIMS = 64


def default_embed(text: Column) -> Column:
    return V.hashed_embedding(T.tokens(text), DIMS)


def as_chunks(pieces: DataFrame, embed: Callable[[Column], Column] | None = default_embed, as_of: Column | None = None, path: str = "file_path") -> DataFrame:
    """Pieces (file_path, chunk_index, title, content, lines) to chunk rows: id, hash, date, kind of source, vector and sign code."""
    session = F.col("session_ts") if "session_ts" in pieces.columns else F.lit(None).cast("string")
    rows = pieces.select(T.chunk_id(F.col(path), F.col("chunk_index")).alias("id"), F.col(path).alias("file_path"), "chunk_index", "start_line", "end_line", "title", "content", T.content_hash(F.col("content")).alias("hash"), T.event_date(F.col("content"), session, F.col(path), as_of if as_of is not None else F.current_date()).alias("event_date"), T.source_kind(F.col(path)).alias("source_kind"))
    if embed is None:
        return rows
    # A structural prefix goes into the vector, not into the content.
    got = rows.withColumn("embedding", embed(F.concat("file_path", F.lit(" | "), F.coalesce("title", F.lit("")), F.lit("\n"), "content")))
    return got.withColumn("code1", V.sign_code(F.col("embedding")))


def signals(chunks: DataFrame, vocabulary: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities of chunks, and their pairs."""
    found = E.chunk_entities(chunks, vocabulary=vocabulary)
    return found, E.co_occurrences(found)


def index_curated(spark: SparkSession, root: str, store: J.Versioned, **options) -> int | None:
    """Notes whose hash has changed are cut and embedded again; notes that are gone go; conversations never do."""
    seen = scan.curated(spark, root).withColumn("hash", T.content_hash(F.col("content")))
    old = store.read()
    if old is None:
        return store.write(as_chunks(S.markdown_chunks(seen), **options).join(seen.select("file_path", F.col("hash").alias("file_hash")), "file_path"))
    stored = old.filter("source_kind = 'curated'").select("file_path", F.col("file_hash").alias("hash")).distinct()
    diff = J.changes(stored, seen)
    if diff.isEmpty():
        return None
    fresh = seen.join(diff.filter("status <> 'D'").select("file_path"), "file_path", "left_semi")
    new = as_chunks(S.markdown_chunks(fresh), **options).join(fresh.select("file_path", F.col("hash").alias("file_hash")), "file_path")
    return store.write(J.delete_keys(old, diff.select("file_path"), "file_path").unionByName(new, allowMissingColumns=True))


def session_chunks(exchanges: DataFrame, most: int = 1600) -> DataFrame:
    """Exchanges without noise to pieces of a session, with its title and time."""
    kept = exchanges.filter(~T.is_noise(F.col("user"), F.col("assistant")))
    rows = kept.select(T.index_path(F.col("file_path")).alias("conv_id"), "exchange", "user", "assistant", F.col("start_line").alias("start_turn"), F.col("end_line").alias("end_turn"), "ts")
    about = rows.groupBy("conv_id").agg(F.min_by("user", "exchange").alias("first"), F.min("ts").alias("ts"))
    project = F.regexp_extract("conv_id", r"^conversations/([^/]*)/", 1)
    return S.exchange_chunks(rows, most).join(about, "conv_id").select(F.col("conv_id").alias("file_path"), "chunk_index", T.session_title(project, F.col("first")).alias("title"), "content", F.col("start_turn").alias("start_line"), F.col("end_turn").alias("end_line"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("session_ts"))


def index_sessions(spark: SparkSession, root: str, store: J.Versioned, **options) -> int | None:
    """Sessions that the index lacks are added; those it has are left as they are."""
    pieces = session_chunks(scan.exchanges(scan.records(scan.conversation_files(spark, root))))
    old = store.read()
    if old is not None:
        pieces = pieces.join(old.select("file_path").distinct(), "file_path", "left_anti")
        if pieces.isEmpty():
            return None
    new = as_chunks(pieces, **options)
    return store.write(new if old is None else old.unionByName(new, allowMissingColumns=True))


def build_reference(spark: SparkSession, root: str, out: str, name: str, embed: Callable[[Column], Column] | None = default_embed) -> None:
    """A stand-alone set of reference documentation, as the partition source=<name>."""
    rows = scan.reference_files(spark, root)
    notes, plain = rows.filter(F.col("file_path").endswith(".md")), rows.filter(~F.col("file_path").endswith(".md"))
    pieces = S.by_heading(notes).unionByName(S.plain_chunks(plain))
    as_chunks(pieces, embed).write.mode("overwrite").parquet(f"{out}/source={name}")


def index_code(files: DataFrame, codebase: str) -> dict[str, DataFrame]:
    """files (file_path, content) of a repository to chunks, symbols, and edges: imports, hierarchy, resolved calls, builds."""
    names = files.select("file_path")
    language = F.coalesce(*(F.when(F.col("file_path").endswith(ext), lang) for ext, lang in S.LANGUAGES.items()))
    symbols = C.symbol_rows(C.symbols(files), codebase)
    found = C.imports(files).select(F.col("file_path").alias("source_file"), "name", "edge_type", language.alias("language"))
    targets = G.import_candidates(names, found.select("source_file", "name", "language").distinct(), files)
    imports = found.join(targets, ["source_file", "name"], "left").select("source_file", "target_file", "edge_type", F.col("name").alias("metadata"), F.lit(None).cast("double").alias("confidence"))
    types = C.hierarchy(files).select(F.col("file_path").alias("source_file"), F.lit(None).cast("string").alias("target_file"), "edge_type", F.col("parent").alias("metadata"), F.lit(None).cast("double").alias("confidence"))
    calls = C.call_sites(files).select(F.xxhash64("file_path", "line", "callee", "receiver").alias("call_id"), F.col("file_path").alias("source_file"), "callee", "receiver").dropDuplicates(["call_id"])
    near = imports.filter("target_file is not null").select("source_file", F.regexp_extract("metadata", r"([^.]+)$", 1).alias("name"), "target_file")
    made = G.resolve_calls(calls, near, symbols.select("short", "file_path")).select("source_file", "target_file", "edge_type", F.col("callee").alias("metadata"), "confidence")
    builds = C.dependency_edges(C.dependencies(files), codebase).select("source_file", "target_file", "edge_type", "metadata", F.lit(None).cast("double").alias("confidence"))
    edges = imports.unionByName(types).unionByName(made).unionByName(builds).withColumn("codebase", F.lit(codebase))
    chunks = as_chunks(S.code_chunks(files).withColumn("file_path", F.concat(F.lit(f"codebase:{codebase}/"), "file_path")), embed=None)
    return {"chunks": chunks, "symbols": symbols, "edges": edges}


def fill_vectors(chunks: DataFrame, path: str | None = None, embed: Callable[[Column], Column] = default_embed) -> DataFrame:
    """Vectors where they are missing, of one file or of all."""
    text = F.concat("file_path", F.lit(" | "), F.coalesce("title", F.lit("")), F.lit("\n"), "content")
    here = F.col("embedding").isNull() if path is None else F.col("embedding").isNull() & (F.col("file_path") == path)
    return chunks.withColumn("embedding", F.when(here, embed(text)).otherwise(F.col("embedding")))


def needs_rebuild(meta: DataFrame | None, config: dict[str, str]) -> bool:
    """Whether a stored setting (model, dims, sizes) differs: then everything is built anew."""
    if meta is None:
        return True
    stored = {r["key"]: r["value"] for r in meta.filter(F.col("key").isin(*config)).collect()}  # a row a setting
    return stored != config


def doctor(chunks: DataFrame, index: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(check, ok, n): counts that must agree, and rows without their parent."""
    ids = chunks.select("id")
    checks = [("duplicate_ids", chunks.groupBy("id").count().filter("count > 1")), ("missing_from_index", chunks.filter(F.size(T.tokens(F.col("content"))) > 0).select("id").join(index.select("id"), "id", "left_anti")), ("orphans_in_index", index.select("id").distinct().join(ids, "id", "left_anti"))]
    if "embedding" in chunks.columns:
        checks.append(("without_embedding", chunks.filter(F.col("embedding").isNull())))
    if entities is not None:
        checks.append(("orphan_entities", entities.select(F.col("chunk_id").alias("id")).distinct().join(ids, "id", "left_anti")))
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), (F.col("n") == 0).alias("ok"), "n") for name, df in checks]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def backfill(chunks: DataFrame, entities: DataFrame | None, as_of: Column, vocabulary: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Dates where they are missing; entities of chunks that have none. Running it again changes nothing."""
    date = F.coalesce("event_date", T.event_date(F.col("content"), F.lit(None).cast("string"), F.col("file_path"), as_of))
    lacking = chunks if entities is None else chunks.join(entities.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_anti")
    fresh = E.chunk_entities(lacking, vocabulary=vocabulary)
    return chunks.withColumn("event_date", date), fresh if entities is None else entities.unionByName(fresh)


def quantized(rows: DataFrame, dims: int, bits: int = 4, seed: int = 42, vec: str = "embedding") -> DataFrame:
    """Vectors of the right size with 4-bit and sign codes; others keep null codes."""
    fits = F.col(vec).isNotNull() & (F.size(vec) == dims)
    good = rows.filter(fits).withColumns({"code4": V.quantize(F.col(vec), dims, bits, seed), "code1": V.sign_code(F.col(vec))})
    return good.unionByName(rows.filter(~F.coalesce(fits, F.lit(False))), allowMissingColumns=True)


def quantization_params(existing: DataFrame | None, model: str, dims: int, bits: int, seed: int, now: Column, spark: SparkSession) -> DataFrame:
    new = spark.range(1).select(F.lit(model).alias("model_name"), F.lit(dims).alias("dims"), F.lit(bits).alias("bit_width"), F.lit(seed).alias("rotation_seed"), F.array(*(F.lit(c) for c in V.centroids(dims, bits))).alias("codebook"), now.alias("created_at"))
    return new if existing is None else J.replace_rows(existing, new, ["model_name", "dims", "bit_width"])


def codes_match(rows: DataFrame, codes: DataFrame) -> bool:
    """Whether a sidecar of codes has exactly one row for each vector: otherwise it is not used."""
    n, m = rows.filter(F.col("embedding").isNotNull()).count(), codes.select("id").distinct().count()
    return n == m == codes.count()


def verify_quantized(rows: DataFrame, k: int = 10, queries: int = 20, floor: float = 0.90, vec: str = "embedding", id_col: str = "id") -> tuple[float, bool]:
    """Recall of two-stage search against exact cosine, over the first rows by hash; `queries` rows come to the driver."""
    asked = rows.filter(F.col(vec).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(queries).select(vec).collect()
    hits = total = 0
    for (q,) in asked:
        exact = {r["id"] for r in R.top(R.cosine_scores(rows, list(q), id_col, vec), k).collect()}
        near = {r["id"] for r in R.two_stage(rows, list(q), k, id_col, vec).collect()}
        hits, total = hits + len(exact & near), total + len(exact)
    recall = hits / total if total else 1.0
    return recall, recall >= floor


def write_note(spark: SparkSession, root: str, file: str, content: str, append: bool = True) -> str:
    """Appends to a note (a line feed first where the note lacks its last one) or replaces it. The path stays below the root and ends
    in .md; the next run of `index_curated` takes the change up."""
    if file.startswith("/") or ".." in file.split("/") or not file.endswith(".md"):
        raise ValueError("not a note's path")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{file}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = ""
    if append and fs.exists(path):
        old = spark.read.text(path.toString(), wholetext=True).first()["value"]
        old += "" if old.endswith("\n") or not old else "\n"
    out = fs.create(path, True)
    out.write(bytearray((old + content).encode()))
    out.close()
    return f"{root}/{file}"


def write_and_index(spark: SparkSession, root: str, file: str, content: str, store: J.Versioned, append: bool = True, **options) -> int | None:
    """A note written and the notes indexed by one holder of the store's lock; the note stays written where another holds it, for that one's
    next run to take up."""
    write_note(spark, root, file, content, append)
    lock = J.FileLock(spark, store.root, "reindex.lock")
    if not lock.acquire():
        return None
    try:
        return index_curated(spark, root, store, **options)
    finally:
        lock.release()


class StageTimer:
    """Seconds by stage of a job."""

    def __init__(self):
        self.spent: dict[str, float] = {}

    def run(self, name: str, step: Callable):
        began = time.time()
        try:
            return step()
        finally:
            self.spent[name] = self.spent.get(name, 0.0) + time.time() - began

    def summary(self) -> dict:
        return {"total": sum(self.spent.values()), "slowest": max(self.spent, key=self.spent.get, default=None), **self.spent}
