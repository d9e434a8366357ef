"""The search entry points: plans put together from operators. The driver only turns the query into literals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions import entities as E
from loomdex.functions import text as T
from loomdex.operators import retrieve as R
from loomdex.runtime import materialise


@dataclass
class Catalog:
    """Tables of one store. Only `chunks` is needed: id, file_path, title, content, embedding, event_date, project."""

    chunks: DataFrame
    entities: DataFrame | None = None
    edges: DataFrame | None = None
    symbols: DataFrame | None = None
    files: DataFrame | None = None
    postings: DataFrame | None = None  # term, id, tf, dl over title and content, with `stats`
    stats: tuple[int, float] | None = None  # rows, mean length
    codes: DataFrame | None = None  # id, code4: packed vectors; ids without one keep their float vector
    addons: dict[str, "Catalog"] = field(default_factory=dict)
    embed: Callable[[str], list[float]] | None = None
    vocabulary: list[str] | None = None
    user: str | None = None


def query_literals(catalog: Catalog, query: str, as_of: str) -> tuple[str | None, list[tuple[str, str]]]:
    """The query's date and entities, by the same expressions as rows, over one row."""
    spark = catalog.chunks.sparkSession
    q = F.lit(query)
    row = spark.range(1).select(T.query_date(q, F.lit(as_of).cast("date")).cast("string").alias("d"), E.entities(q, F.lit(""), catalog.vocabulary).alias("e")).first()
    return row["d"], [(x["entity_type"], x["entity_value"]) for x in row["e"]]


def indexed(catalog: Catalog) -> Catalog:
    """The same store with its tables of search: dated chunks, entities and postings, written once to the shared folder. Searches then
    read a few columns of them: terms prune the postings, and only the texts that are shown are read."""
    rows = materialise(_dated(catalog.chunks), "chunks")
    found = catalog.entities if catalog.entities is not None else materialise(E.chunk_entities(rows, vocabulary=catalog.vocabulary), "entities")
    index = materialise(R.postings(rows, columns=("title", "content")).sortWithinPartitions("term"), "postings")
    return replace(catalog, chunks=rows, entities=found, postings=index, stats=R.index_stats(rows, index))


def keyword_scores(catalog: Catalog, rows: DataFrame, query: str, narrowed: bool = False) -> DataFrame:
    """(id, score) of the keyword signal: from the postings where the store has them, else from the texts."""
    if catalog.postings is None or any("_" in t for t in R.query_terms(query)):  # an index of single terms knows no phrases
        return R.bm25(rows, query, columns={"content": 1.0, "title": 1.0})
    scored = R.bm25_indexed(catalog.postings, catalog.stats, query)
    return scored.join(rows.select("id"), "id", "left_semi") if narrowed else scored


def vector_scores(catalog: Catalog, rows: DataFrame, query: list[float], width: int) -> list[DataFrame]:
    """The vector signal's list, already ranked: cosine over float vectors; where the store has packed codes, their list fused
    with that of the rows that have a float vector alone."""
    if catalog.codes is None:
        return [R.ranked(R.cosine_scores(rows, query), 1, width)]
    packed = catalog.codes.join(rows.select("id"), "id", "left_semi")
    coded = R.ranked(R.code_scores(packed, query, width), 0, width)
    rest = R.ranked(R.cosine_scores(rows.join(catalog.codes.select("id"), "id", "left_anti"), query), 1, width)
    both = R.fuse([coded, rest]).orderBy(*R.fused_order()).limit(width)
    return [both.select("id", F.lit(1).alias("list_no"), F.row_number().over(Window.orderBy(*R.fused_order())).alias("rank"))]


def signals(catalog: Catalog, rows: DataFrame, query: str, width: int, as_of: str, use: tuple[str, ...] = ("keyword", "vector", "temporal", "entity"), narrowed: bool = False) -> list[DataFrame]:
    """Ranked lists of the signals that the query and the tables allow, in the order keyword, vector, temporal, entity.
    `narrowed`: `rows` are some of the store's."""
    day, wanted = query_literals(catalog, query, as_of)
    lists = []
    if "keyword" in use and R.query_terms(query):
        lists.append(R.ranked(keyword_scores(catalog, rows, query, narrowed), 0, width))
    if "vector" in use and catalog.embed is not None and "embedding" in rows.columns:
        lists += vector_scores(catalog, rows, catalog.embed(query), width)
    if "temporal" in use and day and "event_date" in rows.columns:
        lists.append(R.ranked(R.temporal_scores(rows, day, width), 2, width))
    if "entity" in use and wanted and catalog.entities is not None:
        found = catalog.entities.join(rows.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi") if narrowed else catalog.entities
        lists.append(R.ranked(R.entity_scores(found, wanted), 3, width))
    return lists


MODES = {"vector": ("vector",), "keyword": ("keyword",), "hybrid": ("keyword", "vector")}


def search(catalog: Catalog, query: str, mode: str = "hybrid", limit: int = 10, min_score: float = 0.0, metric: str = "cosine") -> DataFrame:
    """(id, score, match_type) by one signal's own scores, or the two fused. `metric` "l2": the vector score is 1 - distance."""
    if limit <= 0:
        return catalog.chunks.select("id", F.lit(0.0).alias("score"), F.lit("").alias("match_type")).limit(0)
    wanted = MODES[mode]
    lists = {}
    if "vector" in wanted and catalog.embed is not None:
        q = catalog.embed(query)
        lists["vector"] = R.distance_scores(catalog.chunks, q) if metric == "l2" else R.cosine_scores(catalog.chunks, q)
    if "keyword" in wanted and R.query_terms(query):
        scored = keyword_scores(catalog, catalog.chunks, query)
        lists["keyword"] = scored.select("id", R.bm25_score(-F.col("score")).alias("score"))
    if len(lists) == 2:
        return R.hybrid(lists["vector"], lists["keyword"], limit, min_score)
    for kind, scored in lists.items():
        return R.top(scored.filter(F.col("score") >= min_score), limit).select("id", "score", F.lit(kind).alias("match_type"))
    return search(catalog, query, mode, 0)


def _dated(rows: DataFrame) -> DataFrame:
    """project and entry_date: columns where they are, else from the title, else from the path."""
    if "entry_date" in rows.columns and "project" in rows.columns:
        return rows
    project = F.col("project") if "project" in rows.columns else F.lit(None).cast("string")
    own = F.col("event_date") if "event_date" in rows.columns else F.lit(None).cast("date")
    return rows.withColumns({"project": F.coalesce(project, T.title_project(F.col("title"))), "entry_date": F.coalesce(T.day(T.title_date(F.col("title"))), T.day(T.date_from_path(F.col("file_path"))), own)})


def narrowing(catalog: Catalog, after: str | None = None, before: str | None = None, project: str | None = None, source: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """The filters of a search, on dated rows."""
    return lambda d: R.by_project(R.by_date(R.by_source(d, source), after, before), project, user=catalog.user)


def memory_search(catalog: Catalog, query: str, max_results: int = 10, min_score: float = 0.0, after: str | None = None, before: str | None = None, project: str | None = None, source: str | None = None, as_of: str = "2025-01-01", compat: bool = False, use: tuple[str, ...] = ("keyword", "vector", "temporal", "entity")) -> DataFrame:
    """Signals, fusion, filters, two results a conversation, and display columns.

    By default filters come before the signals' top-k, so they reach the scan; `compat` filters after an over-fetch of three or five
    times. min_score is held against the raw fused score (at most lists / 61)."""
    if source in catalog.addons:
        return addon_search(catalog.addons[source], source, query, max_results, min_score)
    rows = _dated(catalog.chunks)
    narrow = narrowing(catalog, after, before, project, source)
    filtered = bool(after or before or project or source)
    width = max_results * (5 if filtered else 3) * 2
    lists = signals(catalog, rows if compat else narrow(rows), query, width, as_of, use, narrowed=filtered and not compat)
    if not lists:
        return _shown(R.fuse([rows.select("id", F.lit(0).alias("list_no"), F.lit(0).alias("rank")).limit(0)]).join(rows, "id"), catalog, max_results)
    fused = R.fuse(lists).filter(F.col("score") >= min_score)
    got = F.broadcast(fused).join(rows, "id")  # at most four lists of `width` rows
    return _shown(R.session_cap(narrow(got) if compat else got), catalog, max_results)


def _shown(rows: DataFrame, catalog: Catalog, max_results: int) -> DataFrame:
    best = rows.orderBy(*R.fused_order()).limit(max_results)
    kind = T.source_kind(F.col("file_path"))
    if catalog.files is not None:
        best = best.join(catalog.files.select("file_path", "summary"), "file_path", "left")
    else:
        best = best.withColumn("summary", F.lit(None).cast("string"))
    at = F.row_number().over(Window.orderBy(*R.fused_order()))
    return best.select(at.alias("position"), "id", T.display_path(F.col("file_path")).alias("path"), "file_path", "title", kind.alias("source"), F.col("score"), F.round("score", 3).alias("shown_score"), "entry_date", "project", T.smart_truncate(F.col("content")).alias("snippet"), T.snippet(F.col("summary")).alias("summary"))


def addon_search(addon: Catalog, name: str, query: str, max_results: int = 10, min_score: float = 0.0) -> DataFrame:
    """Keyword and vector alone, without filters; min_score is held against the best max_results."""
    rows = _dated(addon.chunks)
    lists = signals(addon, rows, query, max_results * 3, "2025-01-01", ("keyword", "vector"))
    if not lists:
        return _shown(R.fuse([rows.select("id", F.lit(0).alias("list_no"), F.lit(0).alias("rank")).limit(0)]).join(rows, "id"), addon, max_results)
    best = R.fuse(lists).orderBy(*R.fused_order()).limit(max_results).filter(F.col("score") >= min_score)
    return _shown(F.broadcast(best).join(rows, "id"), addon, max_results).withColumn("source", F.lit(name))


def codebases(meta: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(codebase, files, last_indexed, chunks) of each codebase, by name; `meta` has codebase, file_path, indexed_at."""
    got = meta.groupBy("codebase").agg(F.count("*").alias("files"), F.max("indexed_at").alias("last_indexed"))
    if chunks is None:
        return got.withColumn("chunks", F.lit(0).cast("long")).orderBy("codebase")
    own = F.regexp_extract("file_path", r"^codebase:([^/]+)/", 1)
    n = chunks.filter(F.col("file_path").startswith("codebase:")).groupBy(own.alias("codebase")).agg(F.count("*").alias("chunks"))
    return got.join(n, "codebase", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("long"))).orderBy("codebase")


def choose_addons(found: DataFrame, model: str) -> DataFrame:
    """(stem, path, precedence, model): of each stem the first by precedence, if its model fits or isn't told."""
    w = Window.partitionBy("stem").orderBy("precedence", "path")
    return found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").filter(F.col("model").isNull() | (F.col("model") == model))


def new_entities(results: DataFrame, known: list[tuple[str, str]], vocabulary: list[str] | None = None, top: int = 5) -> list[tuple[str, str]]:
    """Entities of the first results that the query does not name; five rows come to the driver."""
    rows = results.filter(F.col("position") <= top).select("position", F.inline(E.entities(F.col("content"), F.col("title"), vocabulary))).orderBy("entity_type", "entity_value").collect()
    have = set(known)
    return list(dict.fromkeys((r["entity_type"], r["entity_value"]) for r in rows if (r["entity_type"], r["entity_value"]) not in have))


def memory_deep_search(catalog: Catalog, query: str, max_results: int = 10, min_score: float = 0.0, as_of: str = "2025-01-01", max_hops: int = 1, after: str | None = None, before: str | None = None, project: str | None = None, source: str | None = None) -> DataFrame:
    """A second pass by the entities that the snippets of the first pass's five best results name and the query doesn't; both passes keep
    to the filters. (hop, position, ...), hop 0 or 1. Ranked on unrounded score, then hop, then id. Without hops, or new entities, the
    first pass stands alone."""
    filters = {"after": after, "before": before, "project": project, "source": source}
    first = materialise(memory_search(catalog, query, 2 * max_results, 0.0, as_of=as_of, **filters).withColumn("hop", F.lit(0)), "first-pass")
    every = first
    if max_hops > 0 and source not in catalog.addons:
        _, known = query_literals(catalog, query, as_of)
        fresh = new_entities(first.withColumn("content", F.col("snippet")), known, catalog.vocabulary)
        width = 3 * max_results
        rows = narrowing(catalog, **filters)(_dated(catalog.chunks))
        narrowed = any(filters.values())
        lists = []
        if fresh and catalog.entities is not None:
            found = catalog.entities.join(rows.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi") if narrowed else catalog.entities
            lists.append(R.ranked(R.entity_scores(found, fresh), 0, width))
        terms = " ".join(v for _, v in fresh[:10])
        if R.query_terms(terms):
            lists.append(R.ranked(keyword_scores(catalog, rows, terms, narrowed), 1, width))
        if lists:
            more = F.broadcast(R.fuse(lists)).join(rows, "id").join(F.broadcast(first.select("id")), "id", "left_anti")
            every = first.unionByName(_shown(more, catalog, 2 * width).withColumn("hop", F.lit(1)))
    order = [F.desc("score"), F.col("hop"), F.col("id")]
    every = R.session_cap(every.filter(F.col("score") >= min_score), order=order)
    return every.orderBy(*order).limit(max_results).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def search_with_signals(catalog: Catalog, query: str, use: tuple[str, ...], limit: int = 10, as_of: str = "2025-01-01") -> DataFrame:
    """(id, score, rank) of any combination of signals, for comparisons; with "deep_search" among them the lists of a second pass, by the
    entities of the first one's five best, are fused with the first pass's."""
    rows = _dated(catalog.chunks)
    width = 3 * limit
    lists = signals(catalog, rows, query, width, as_of, use)
    if not lists:
        return rows.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    order = F.row_number().over(Window.orderBy(*R.fused_order()))
    best = materialise(R.fuse(lists).orderBy(*R.fused_order()).limit(width).withColumn("rank", order), "combination")
    if "deep_search" in use:
        top = best.filter("rank <= 5").join(rows.select("id", "title", "content"), "id").withColumn("position", F.col("rank"))
        fresh = new_entities(top, query_literals(catalog, query, as_of)[1], catalog.vocabulary)
        second = []
        if fresh and catalog.entities is not None:
            second.append(R.ranked(R.entity_scores(catalog.entities, fresh), 0, width))
        terms = " ".join(v for _, v in fresh[:10])
        if R.query_terms(terms):
            second.append(R.ranked(keyword_scores(catalog, rows, terms), 1, width))
        if second:
            more = R.fuse(second).orderBy(*R.fused_order()).limit(width).withColumn("rank", order)
            passes = [df.select("id", F.lit(i).alias("list_no"), "rank") for i, df in enumerate((best, more))]
            best = R.fuse(passes).orderBy(*R.fused_order()).limit(limit).withColumn("rank", order)
    return best.filter(F.col("rank") <= limit).select("id", "score", "rank")


def file_record(files: DataFrame, path: str) -> DataFrame:
    """A file's row, by its path; its `summary` is the file's."""
    return files.filter(F.col("file_path") == path).limit(1)


def codebase_search(catalog: Catalog, query: str, codebase: str | None = None, max_results: int = 10) -> DataFrame:
    """Keyword and vector over code chunks of one codebase, boosted by in-degree, with a label of the file's symbol."""
    rows = catalog.chunks.filter(F.col("file_path").startswith(f"codebase:{codebase}/" if codebase else "codebase:"))
    lists = signals(catalog, rows, query, max_results * 3, "2025-01-01", ("keyword", "vector"), narrowed=True)
    empty = rows.select("id", F.lit(0).alias("list_no"), F.lit(0).alias("rank")).limit(0)
    got = F.broadcast(R.fuse(lists or [empty])).join(rows.select("id", "file_path", "title", "content"), "id")
    got = got.withColumns({"codebase": F.regexp_extract("file_path", r"^codebase:([^/]+)/", 1), "rel_path": F.regexp_extract("file_path", r"^codebase:[^/]+/(.*)$", 1)})
    if catalog.edges is not None:
        degree = catalog.edges.filter(F.col("target_file").isNotNull()).groupBy("codebase", F.col("target_file").alias("rel_path")).agg(F.count("*").alias("in_degree"))
        got = got.join(degree, ["codebase", "rel_path"], "left")
    else:
        got = got.withColumn("in_degree", F.lit(0).cast("long"))
    got = got.withColumn("in_degree", F.coalesce("in_degree", F.lit(0))).withColumn("score", F.col("score") * (1 + F.log1p("in_degree") * 0.1))
    if catalog.symbols is not None:
        label = F.get_json_object("metadata", "$.label")
        labels = catalog.symbols.withColumn("label", label).filter("label is not null").groupBy("codebase", F.col("file_path").alias("rel_path")).agg(F.min_by("label", F.struct("start_line", "name")).alias("label"))
        got = got.join(labels, ["codebase", "rel_path"], "left")
    else:
        got = got.withColumn("label", F.lit(None).cast("string"))
    return got.orderBy(F.desc("score"), "list_no", "rank", "id").limit(max_results).select("id", "codebase", "rel_path", "title", F.col("score"), "in_degree", "label", T.snippet(F.col("content"), 300).alias("snippet"))


def read_lines(files: DataFrame, path: str, start: int = 1, lines: int | None = None) -> DataFrame:
    """1-based lines of a file."""
    parts = F.split("content", "\n")
    some = F.slice(parts, start, F.lit(lines) if lines is not None else F.greatest(F.size(parts), F.lit(1)))
    return files.filter(F.col("file_path") == path).select(F.posexplode(some).alias("pos", "text")).select((F.col("pos") + start).alias("line"), "text")


def read_conversation(chunks: DataFrame, uuid: str) -> DataFrame:
    """A conversation by its id, chunks in order."""
    rows = chunks.filter(F.contains("file_path", F.lit(uuid)) & F.col("file_path").startswith("conversations/"))
    return rows.groupBy("file_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]), "\n\n").alias("content"))


def status(catalog: Catalog) -> DataFrame:
    """Counts by kind of source, and of rows without an embedding."""
    kinds = catalog.chunks.withColumn("source", T.source_kind(F.col("file_path")))
    missing = F.count_if(F.col("embedding").isNull()) if "embedding" in catalog.chunks.columns else F.count("*")
    return kinds.groupBy("source").agg(F.count("*").alias("chunks"), F.count_distinct("file_path").alias("files"), missing.alias("without_embedding"))
