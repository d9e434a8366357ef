"""Secret scans over a ledger of content-addressed blobs.

Every historical version of a path is a blob named by its SHA-256. The ledger has a row for each blob and
rule version that has been scanned, with its findings. A scan takes the distinct addresses, drops the pairs the ledger
knows, fetches the texts of what is left alone, runs it, appends it, and joins findings back to all paths that hold the blob, old or
new. Only DataFrame functions run. Copies meet first in each map task (partial aggregation), so a blob that holds a
third of all rows is one row a task; the join back splits a hot blob's paths, whose other side has one row.

The query scans in two steps, as a store does that has been scanned before: blobs of half the addresses into a new ledger, then all
versions against that ledger, which fetches and scans the other half alone.

Cases. Null text is the empty blob; so is empty text. Null paths stay. Repeated versions give a row each. An
empty table gives an empty result and adds nothing. Offsets are code points. Only the two named columns are
read, so extra columns may have any name. Texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import spans as S
from loomdex.runtime import materialise, shared_path

#: Fixed patterns. For the first three: leftmost matches, those too short are dropped without a second try.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KEY_HEAD = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
#: The key with its body: up to the END line, over all that isn't another block's line; where END is missing, header fields and
#: then base64 runs of 16 or more, with line breaks (also as escapes), quotes and line marks between them, and a short last run
#: that is padded or ends the text. Possessive throughout: each place is read once.
KEY_GAP = r"""(?:\\[nr]|[\s"',;>#*|+])*+"""
KEY_BLOCK = (
    KEY_HEAD
    + r"(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    + rf"|(?:{KEY_GAP}(?:Proc-Type|DEK-Info): [^\n\\]*+)*+(?:{KEY_GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+(?:{KEY_GAP}[A-Za-z0-9+/]++(?:={{1,2}}+|(?=\s*+\z)))?+)"
)
WEB_TOKEN = r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"


def _assign(text: Column) -> Column:
    value = lambda s: F.regexp_extract(s["text"], ASSIGN, 1)
    return S.spans(text, ASSIGN, lambda s: F.length(value(s)) >= 8)


#: name: (version, scan); a rule whose pattern changes gets a new version and is run again on all blobs.
RULES = {
    "assign": (1, _assign),
    "access": (1, lambda t: S.spans(t, ACCESS)),
    "hex": (1, lambda t: S.spans(t, HEX)),
    "key_block": (2, lambda t: S.spans(t, KEY_BLOCK, hint=KEY_HEAD)),
    "web_token": (1, lambda t: S.spans(t, WEB_TOKEN)),
}
BASE = ("assign", "access", "hex")
LEDGER = "blob string, rule string, version int, findings array<struct<start:int,end:int>>"


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def scan_blobs(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: dict | None = None, broadcast_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(added, by_blob): the ledger rows this scan adds, written to the shared folder, and for each blob that the whole
    ledger has findings of: blob, findings = array<struct<rule,start,end>> by start, then rule as listed."""
    rules = RULES if rules is None else rules
    spark = versions.sparkSession
    rows = versions.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    current = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(v).alias("version")) for r, (v, _) in rules.items()))
    if ledger is None:
        work = rows.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", current)
    else:
        done = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("done"))
        asked = rows.select("blob").distinct().join(done, "blob", "left")
        left = F.array_except(current, F.coalesce("done", F.array().cast("array<struct<rule:string,version:int>>")))
        unseen = materialise(asked.select("blob", left.alias("todo")).filter(F.size("todo") > 0), "secret-work")
        if unseen.count() <= broadcast_rows:  # then the texts of these alone travel
            rows = rows.join(F.broadcast(unseen.select(F.unhex("blob").alias("due"))), F.unhex("blob") == F.col("due"), "left_semi")
        work = rows.groupBy("blob").agg(F.first("text").alias("text")).join(unseen, "blob")
    due = lambda r, v: F.array_contains("todo", F.struct(F.lit(r).alias("rule"), F.lit(v).alias("version")))
    bare = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    each = [F.when(due(r, v), F.struct(F.lit(r).alias("rule"), F.lit(v).alias("version"), bare(f(F.col("text"))).alias("findings"))) for r, (v, f) in rules.items()]
    folder = shared_path(spark, "secret-ledger")
    # A blob without findings is known as scanned by its rows all the same: one a blob and rule.
    work.select("blob", F.filter(F.array(*each), lambda x: x.isNotNull()).alias("each")).select("blob", F.inline("each")).write.parquet(folder)
    added = spark.read.schema(LEDGER).parquet(folder)
    known = added if ledger is None else ledger.select("blob", "rule", "version", "findings").unionByName(added)
    hits = known.filter((F.size("findings") > 0) & F.array_contains(current, F.struct(F.col("rule"), F.col("version"))))
    rank = F.array_position(F.array(*map(F.lit, rules)), F.col("rule"))
    flat = hits.select("blob", "rule", rank.alias("rank"), F.explode("findings").alias("f"))
    by_blob = flat.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct(F.col("f.start").alias("start"), F.col("rank"), F.col("f.end").alias("end"), F.col("rule")))).alias("findings"))
    return added, by_blob.select("blob", F.transform("findings", lambda s: F.struct(s["rule"].alias("rule"), s["start"].alias("start"), s["end"].alias("end"))).alias("findings"))


NONE = "array<struct<rule:string,start:int,end:int>>"


def scan(versions: DataFrame, ledger: DataFrame | None = None, path: str = "path", text: str = "text", rules: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(added, findings): the ledger rows this scan adds, and a row for each version: path, blob, findings."""
    added, by_blob = scan_blobs(versions, ledger, text, rules)
    paths = versions.select(F.col(path).alias("path"), address(F.col(text)).alias("blob"))
    return added, paths.join(by_blob, "blob", "left").select("path", "blob", F.coalesce("findings", F.array().cast(NONE)).alias("findings"))


def redacted(text: Column, findings: Column, sign: str = "[SECRET]") -> Column:
    """The text with each finding, or run of overlapping findings, replaced."""
    places = F.transform(findings, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    runs = F.transform(S.clusters(places), lambda c: F.struct(c[0]["start"].alias("start"), F.array_max(F.transform(c, lambda s: s["end"])).alias("end")))

    def joined(parts: Column, r: Column) -> Column:
        before = F.transform(r, lambda x, i: F.concat(S.cut(parts, F.when(i > 0, F.get(r, i - 1)["end"]).otherwise(0), x["start"]), F.lit(sign)))
        rest = S.cut(parts, F.coalesce(F.try_element_at(r, F.lit(-1))["end"], F.lit(0)), F.size(parts) * S.BLOCK)
        return F.concat(F.array_join(before, ""), rest)

    return S.let(S.blocks(text), lambda parts: S.let(runs, lambda r: joined(parts, r)))


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, _ = scan_blobs(docs.filter(address(F.col("text")) < "8"))
    _, back = scan(docs, before, path="doc_id")
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("findings", lambda s: s["rule"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("findings", lambda s: s["rule"].isin(*BASE))
    return back.select(F.col("path").cast("long").alias("doc_id"), *map(count, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"), "blob")
