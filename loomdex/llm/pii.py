"""Personal data: exact base patterns, and boosted trees over further candidates.

Base spans (email, ip, card, phone) are leftmost non-overlapping matches whose failing ones are dropped; they always stay.
High-recall generators then propose overlapping spans that the base misses (spelled-out addresses, numbers without a country code in any
grouping, card numbers next to other digits, social and bank account numbers). Each candidate gets format, checksum and context
features by Spark expressions; its kind's boosted trees, compiled to CASE expressions, score it; a threshold of its kind, set on held-out
documents by the precision asked for, selects it; of overlapping selected spans the best score stays (taken best first, so a span that
is itself dropped hides nothing). A document costs one projection: no shuffle, no Python on executors, and work in proportion to its
text and matches.

The trees are fitted on the driver, on two sets of bounded size whose rows are features alone. Real candidates: of `FIT_DOCS` documents that
hold digits (the smallest by a hash of the id), at most `FIT_ROWS` candidates, labelled by strict checks: numbers inside a valid base
phone, or of 16 digits that pass Luhn, are personal; digits of IP addresses, of failing card numbers and other runs are not. Planted
candidates: `PLANTED` spellings, local numbers, social and account numbers, and look-alikes (dates, versions, sums, failing
checksums), put into contexts cut from those documents; a candidate of another kind in them is none of its own. A quarter of the documents, and of the planted rows, is held out of
the fit and sets the thresholds. `report` gives precision and recall a kind on them.

Cases. Null text counts as empty; empty text has no spans. Repeated rows give equal rows. Very long texts are read
whole; patterns are possessive, so a long run of one character class costs one pass. An empty table gives an empty
result. Without documents to cut contexts from, planted rows stand alone. Only the two named columns are read. Offsets are code
points, ends exclusive. Added spans that tie in score go by start, then by kind as listed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.llm import spans as S
from loomdex.runtime import materialise

#: Fixed patterns. A match starts at the last match's end or where no character of its first class stands before;
#: possessive loops give the same matches as greedy ones here, as what follows is never of the loop's class.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BASE = ("email", "ip", "card", "phone")

#: Generators of further candidates, in the order of their kinds.
GENERATORS = {
    "email_spelled": r"[A-Za-z0-9._%+-]{2,64}+ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]{2,63}+(?:(?: ?(?:\[dot\]|\(dot\)|\{dot\}) ?|\.)[A-Za-z]{2,24}+){1,4}+",
    "phone_local": r"(?<![0-9A-Za-z])\(?[0-9]{2,5}+\)?(?:[ ./-][0-9]{2,8}+){1,5}+(?![0-9A-Za-z])",
    "card_close": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: What every text holds that a generator matches in.
HINTS = {"email_spelled": r"(?:\[at\]|\(at\)|\{at\})", "phone_local": r"[0-9]\)?[ ./-][0-9]{2}", "card_close": r"[0-9]{4}[ -]?[0-9]{4}", "social": r"[0-9]-[0-9]{2}-[0-9]", "account": r"[A-Z]{2}[0-9]{2}"}
CUES = r"(?i)(?:phone|tel|call|fax|mobile|cell|mail|contact|reach|card|visa|iban|account|ssn|social|security|nummer|konto|courriel|correo|write)[^A-Za-z]{0,12}[a-z]{0,8}[^A-Za-z]{0,4}$"
AGAINST = r"(?i)(?:version|order|invoice|page|ref|sku|isbn|serial|build|figure|table|part|model|ticket|sum|total|hash|id)[^A-Za-z]{0,6}$"
FEATURES = ("digits", "length", "marks", "groups", "luhn", "checksum", "area", "date", "distinct", "upper", "bracket", "ending", "before_word", "after_word", "before_digit", "after_digit", "cue", "against", "first")
FIT_DOCS, FIT_ROWS, PLANTED = 4000, 8000, 4000
FOUND = "array<struct<rank:int,start:int,end:int,text:string," + ",".join(f"{f}:double" for f in FEATURES) + ">>"


def base_spans(text: Column) -> dict[str, Column]:
    count = lambda s: F.length(S.digits(s["text"]))
    return {
        "email": S.spans(text, EMAIL, hint="@"),
        "ip": S.spans(text, IP, lambda s: s["text"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), hint=r"[0-9]\.[0-9]"),
        "card": S.spans(text, CARD, lambda s: (count(s) >= 16) & (count(s) <= 19) & S.luhn(S.digits(s["text"])), hint=r"[0-9](?:[\x20-]?[0-9]){15}"),
        "phone": S.spans(text, PHONE, lambda s: (count(s) >= 8) & (count(s) <= 15), hint=r"\+[0-9]"),
    }


def mod97(number: Column) -> Column:
    """Of an account number: its first four characters go last, letters count from 10, and all of it is taken modulo 97; right ones leave 1."""
    plain = F.regexp_replace(number, "[^A-Za-z0-9]", "")
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(F.upper(c)) - 55)
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda a, c: S.let(value(c), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97))


def candidates(text: Column) -> Column:
    """All generators' spans with their features."""

    def described(parts: Column, rank: int, found: Column) -> Column:
        """Spans of one generator with their features."""

        def features(s: Column, number: Column, before: Column, after: Column) -> Column:
            got = s["text"]
            flag = lambda c: c.cast("double")
            values = {
                "digits": F.length(number),
                "length": F.length(got),
                "marks": F.length(F.regexp_replace(got, "[A-Za-z0-9]", "")),
                "groups": F.size(F.split(got, "[^A-Za-z0-9]+")),
                "luhn": flag(S.luhn(number)),
                "checksum": flag((mod97(got) == 1) & got.rlike("^[A-Z]{2}[0-9]{2}")),
                "area": flag(number.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")),
                "date": flag(got.rlike(r"^(?:(?:1[5-9]|20)[0-9]{2}[ ./-][0-9]{1,4}(?:[ ./-][0-9]{1,2})?|[0-3]?[0-9][ ./-][01]?[0-9][ ./-](?:1[5-9]|20)?[0-9]{2})$")),
                "distinct": F.size(F.array_distinct(F.split(number, ""))),
                "upper": F.length(F.regexp_replace(got, "[^A-Z]", "")),
                "bracket": flag(got.startswith("(") & got.contains(")")),
                "ending": flag(got.rlike("[^A-Za-z][A-Za-z]{2,3}$")),
                "before_word": flag(before.rlike("[A-Za-z0-9]$")),
                "after_word": flag(after.rlike("^[A-Za-z0-9]")),
                "before_digit": flag(before.rlike("[0-9][ .,:/-]?$")),
                "after_digit": flag(after.rlike("^[ .,:/-]?[0-9]")),
                "cue": flag(before.rlike(CUES)),
                "against": flag(before.rlike(AGAINST)),
                "first": F.when(F.length(number) > 0, F.substr(number, F.lit(1), F.lit(1)).cast("double")).otherwise(-1.0),
            }
            return F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), got.alias("text"), *(F.coalesce(values[k].cast("double"), F.lit(0.0)).alias(k) for k in FEATURES))

        def each(s: Column) -> Column:
            # The sign and code of an international number are no part of what stands before a local one.
            before = F.regexp_replace(S.cut(parts, s["start"] - 32, s["start"]), r"\+[0-9]{1,3}[ .-]?$", "")
            return S.let(S.digits(s["text"]), lambda n: S.let(before, lambda x: S.let(S.cut(parts, s["end"], s["end"] + 3), lambda y: features(s, n, x, y))))

        return F.transform(found, each)

    any_hint = F.lit(False)
    for hint in HINTS.values():
        any_hint = any_hint | text.rlike(hint)
    every = lambda parts: F.concat(*(described(parts, rank, S.spans(text, pattern, hint=HINTS[kind])) for rank, (kind, pattern) in enumerate(GENERATORS.items())))
    return F.when(any_hint, S.let(S.blocks(text), every)).otherwise(F.array().cast(FOUND))


# ---------------------------------------------------------------- what the trees are fitted on
def planted(contexts: DataFrame) -> DataFrame:
    """contexts (id, left, right) to (id, wanted, rank of the kind, text): personal data, and look-alikes, between words of real texts."""
    draw = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m))
    pick = lambda salt, *xs: F.element_at(F.array(*map(F.lit, xs)), (draw(salt, len(xs)) + 1).cast("int"))
    number = lambda salt, width, least=0: F.lpad((draw(salt, 10**width - least) + least).cast("string"), width, "0")
    wanted = draw("label", 2) == 1
    stem = F.concat(F.lit("4"), number("c", 14))
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.substr(stem, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)), F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    good = F.concat(stem, ((10 - total % 10) % 10).cast("string"))
    bad = F.concat(stem, ((10 - total % 10 + 1 + draw("off", 9)) % 10).cast("string"))
    gap = pick("gap", "", " ", "-")
    fours = lambda x: F.concat_ws(" ", F.concat(F.substr(x, F.lit(1), F.lit(4)), gap, F.substr(x, F.lit(5), F.lit(4)), gap, F.substr(x, F.lit(9), F.lit(4)), gap, F.substr(x, F.lit(13), F.lit(4))), number("near", 2))
    part = pick("s", " ", "-", ".")
    forms = [F.concat(F.lit("("), number("p1", 3), F.lit(") "), number("p2", 3), F.lit("-"), number("p3", 4)), F.concat_ws("-", number("p1", 3, 200), number("p2", 3), number("p3", 4)), F.concat(F.lit("0"), number("p1", 1), *(x for i in range(4) for x in (part, number(f"q{i}", 2)))), F.concat(F.lit("0"), number("p1", 2), pick("s2", " ", "/", "-"), number("p2", 7))]
    local = F.element_at(F.array(*forms), (draw("form", len(forms)) + 1).cast("int"))
    others = [F.concat_ws("-", (draw("y", 120) + 1900).cast("string"), F.lpad((draw("m", 12) + 1).cast("string"), 2, "0"), F.lpad((draw("d", 28) + 1).cast("string"), 2, "0")), F.concat_ws("-", (draw("y", 120) + 1900).cast("string"), (draw("y2", 30) + 2000).cast("string")), F.concat_ws(".", number("v1", 2), number("v2", 2), number("v3", 2)), F.concat_ws(" ", number("v1", 2), number("v2", 3), number("v3", 3)), F.concat_ws("/", number("v1", 2), number("v2", 2)), F.concat_ws(".", number("v1", 3), number("v2", 3), number("v3", 2))]
    other = F.element_at(F.array(*others), (draw("other", len(others)) + 1).cast("int"))
    social = F.concat_ws("-", F.lpad((draw("a1", 664) + 1).cast("string"), 3, "0"), F.lpad((draw("a2", 99) + 1).cast("string"), 2, "0"), F.lpad((draw("a3", 9998) + 1).cast("string"), 4, "0"))
    no_social = F.concat_ws("-", pick("b1", "000", "666", "912", "987", "955"), number("a2", 2), number("a3", 4))
    body = F.concat(number("b2", 8), number("b3", 8), number("b4", 2))
    land = pick("cc", "DE", "FR", "GB", "ES")
    check = F.lpad((98 - mod97(F.concat(land, F.lit("00"), body))).cast("string"), 2, "0")
    wrong = F.lpad(((check.cast("int") + 1 + draw("b5", 90)) % 97).cast("string"), 2, "0")
    account = lambda c: F.concat(land, c, F.lit(" "), F.regexp_replace(body, "(.{4})", "$1 "))
    email = F.concat(pick("u", "ann.lee", "j_smith", "info7", "bert"), pick("at", " [at] ", "(at)", " (at) "), pick("h", "mail", "corp-x", "example"), pick("dot", " [dot] ", ".", "(dot)"), pick("tld", "com", "org", "de"))
    kind = draw("kind", 6)
    cue = pick("cue", "phone ", "call me at ", "contact: ", "mobile ", "my card ", "write to ", "account ", "security no ", "tel. ", "", "", "", "")
    against = pick("against", "order ", "version ", "invoice ", "serial ", "part ", "total ", "ticket ", "page ", "", "", "", "")
    yes = F.when(kind == 0, email).when(kind <= 2, local).when(kind == 3, fours(good)).when(kind == 4, social).otherwise(account(check))
    no = F.when(kind == 0, F.concat(pick("u", "look", "meet"), F.lit(" (at) noon.then"))).when(kind <= 2, other).when(kind == 3, fours(bad)).when(kind == 4, no_social).otherwise(account(wrong))
    text = F.concat("left", F.lit(" "), F.when(wanted, cue).otherwise(against), F.when(wanted, yes).otherwise(no), pick("tail", " ", ". ", ", ", "\n"), "right")
    rank = F.when(kind == 0, 0).when(kind <= 2, 1).otherwise(kind - 1)
    return contexts.select("id", wanted.cast("int").alias("wanted"), rank.cast("int").alias("rank"), text.alias("text"))


def fit_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, most: int = FIT_ROWS) -> DataFrame:
    """(held, rank, wanted, features): candidates of both sets with their labels, bounded by `fit_docs`, `most` and PLANTED."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("id").isNotNull() & F.col("text").rlike("[0-9][0-9]"))
    chosen = rows.select("id").distinct().orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(fit_docs)
    sample = materialise(rows.join(F.broadcast(chosen), "id"), "pii-sample")
    text = F.col("text")
    spans = base_spans(text)
    inside = lambda c, spans: F.exists(spans, lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"]))
    # Only candidates that the strict checks can speak of: cards, and local numbers.
    label = lambda c, phones: F.when(c["rank"] == 1, inside(c, phones) & (c["digits"] >= 7)).when(c["rank"] == 2, c["luhn"] == 1)
    real = sample.select("id", S.let(spans["phone"], lambda p: F.transform(candidates(text), lambda c: F.struct(label(c, p).cast("int").alias("wanted"), c.alias("c")))).alias("x"))
    order = F.xxhash64("id", "x.c.start", "x.c.rank")
    real = real.select("id", F.explode("x").alias("x")).filter("x.wanted is not null").orderBy(order, "id", "x.c.start").limit(most).select((F.pmod(F.xxhash64(F.lit(8), "id"), F.lit(4)) == 0).alias("held"), F.col("x.c.rank").alias("rank"), "x.wanted", *(F.col(f"x.c.{k}") for k in FEATURES))
    # One context a document: 28 signs before and 12 after the place where a planted number goes.
    at = F.pmod(F.xxhash64("id", F.lit("at")), F.greatest(F.length("text") - 40, F.lit(1))).cast("int")
    side = lambda start, size: F.coalesce(F.regexp_replace(F.substr("text", start, F.lit(size)), "[0-9@+()\\[\\]-]", ""), F.lit(""))
    order = Window.orderBy(F.xxhash64("id"), "left", "right")
    sides = materialise(sample.select("id", side(at + 1, 28).alias("left"), side(at + 29, 12).alias("right")).withColumn("n", F.row_number().over(order) - 1).select("n", "left", "right"), "pii-contexts")
    places = spark.range(PLANTED).withColumn("n", F.pmod("id", F.lit(max(1, sides.count()))))
    contexts = places.join(F.broadcast(sides.filter(F.col("n") < PLANTED)), "n", "left").select("id", F.coalesce("left", F.lit("")).alias("left"), F.coalesce("right", F.lit("")).alias("right"))
    own = planted(contexts).select("id", "wanted", "rank", F.explode(candidates(text)).alias("c")).select((F.pmod("id", F.lit(4)) == 0).alias("held"), "c.rank", F.when(F.col("c.rank") == F.col("rank"), F.col("wanted")).otherwise(0).alias("wanted"), *(F.col(f"c.{k}") for k in FEATURES))
    return real.unionByName(own)


# ---------------------------------------------------------------- boosting, on the driver
def boost(x: np.ndarray, y: np.ndarray, trees: int = 24, rate: float = 0.3, cuts: int = 12, least: int = 8) -> tuple[float, list]:
    """Depth-2 trees on the logistic loss: (start, [(feature, cut, side, side)]), a side being a (feature, cut, low, high)."""
    grid = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, cuts))) for j in range(x.shape[1])]
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    f, model = np.full(len(y), start), []

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        gain = lambda a, b: a * a / (b + 1.0)
        best = (0.0, 0, float("inf"))
        for j, edges in enumerate(grid):
            for c in edges.tolist():
                low = rows & (x[:, j] <= c)
                if least <= low.sum() <= rows.sum() - least:
                    s = gain(g[low].sum(), h[low].sum()) + gain(g[rows & ~low].sum(), h[rows & ~low].sum())
                    if s > best[0] + 1e-9:
                        best = (s, j, c)
        return best[1:]

    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        leaf = lambda rows: rate * float(g[rows].sum() / (h[rows].sum() + 1.0))
        j, c = split(np.ones(len(y), bool), g, h)
        sides, step = [], np.zeros(len(y))
        for rows in (x[:, j] <= c, x[:, j] > c):
            i, d = split(rows, g, h)
            low, high = rows & (x[:, i] <= d), rows & (x[:, i] > d)
            values = (leaf(low), leaf(high))
            step[low], step[high] = values
            sides.append((i, d, *values))
        f = f + step
        model.append((j, c, *sides))
    return start, model


def raw_score(model: tuple[float, list], get) -> Column | np.ndarray:
    """The trees as one expression; get(j) is feature j."""
    total = F.lit(model[0])
    for j, c, a, b in model[1]:
        side = lambda s: F.when(get(s[0]) <= F.lit(float(s[1])), F.lit(s[2])).otherwise(F.lit(s[3]))
        total = total + F.when(get(j) <= F.lit(float(c)), side(a)).otherwise(side(b))
    return total


def evaluate(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    total = np.full(len(x), model[0])
    for j, c, a, b in model[1]:
        side = lambda s: np.where(x[:, s[0]] <= s[1], s[2], s[3])
        total += np.where(x[:, j] <= c, side(a), side(b))
    return total


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.98, fit_docs: int = FIT_DOCS) -> tuple[list, list[float], list[dict]]:
    """For each generator its trees, a threshold of raw score (of those whose held-out precision is as asked the one that catches most, then the
    most precise), and the held-out figures: kind, rows, precision, recall."""
    found = fit_rows(docs, id_col, text_col, fit_docs).collect()
    rows = np.array(sorted([float(v) for v in r] for r in found)).reshape(-1, 3 + len(FEATURES))
    models, thresholds, figures = [], [], []
    for rank, kind in enumerate(GENERATORS):
        own, held = rows[:, 1] == rank, rows[:, 0] == 1
        models.append(boost(rows[own & ~held, 3:], rows[own & ~held, 2]))
        s, t = evaluate(models[-1], rows[own & held, 3:]), rows[own & held, 2]
        cuts = np.unique(s)  # rows that tie are selected together
        right = np.array([t[s >= c].mean() for c in cuts])
        caught = np.array([t[s >= c].sum() for c in cuts])
        fine = np.flatnonzero(right >= precision)
        best = max(fine.tolist(), key=lambda i: (caught[i], right[i])) if len(fine) else None
        thresholds.append(float(cuts[best]) if best is not None else float("inf"))
        chosen = s >= thresholds[-1]
        figures.append({"kind": kind, "rows": len(t), "precision": float(t[chosen].mean()) if chosen.any() else None, "recall": float(t[chosen].sum() / t.sum()) if t.sum() else None})
    return models, thresholds, figures


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.98, fit: tuple | None = None) -> DataFrame:
    """doc_id, base and added: arrays of (rank, start, end, kind), by kind as listed, then start. `fit`: what `fitted` gave, to be used again."""
    models, thresholds, _ = fit or fitted(docs, id_col, text_col, precision)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    base = F.concat(*(S.named(kind, i, got) for i, (kind, got) in enumerate(base_spans(text).items())))
    got = rows.select("doc_id", base.alias("base"), candidates(text).alias("candidates"))
    names, limits = F.array(*map(F.lit, GENERATORS)), F.array(*(F.lit(t) for t in thresholds))
    item = lambda s, score, rank: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(score).alias("score") if isinstance(score, float) else score.alias("score"), rank.alias("rank"))
    by_kind = lambda c: F.coalesce(*(F.when(c["rank"] == rank, raw_score(m, lambda j: c[FEATURES[j]])) for rank, m in enumerate(models)))
    scored = F.transform("candidates", lambda c: item(c, by_kind(c), c["rank"]))
    chosen = F.filter(scored, lambda c: c["score"] >= F.get(limits, c["rank"]))
    settled = F.transform("base", lambda b: item(b, float("inf"), F.lit(-1)))
    apart = lambda a, b: (a["end"] <= b["start"]) | (b["end"] <= a["start"])
    best_first = lambda c: F.sort_array(F.transform(c, lambda x: F.struct((-x["score"]).alias("score"), x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"))))
    kind = "array<struct<score:double,start:int,rank:int,end:int>>"
    taken = lambda c: F.aggregate(best_first(c), F.array().cast(kind), lambda a, x: F.when((x["rank"] < 0) | F.forall(a, lambda k: apart(k, x)), F.concat(a, F.array(x))).otherwise(a))
    kept = F.filter(F.flatten(F.transform(S.clusters(F.concat(chosen, settled)), lambda c: taken(c))), lambda x: x["rank"] >= 0)
    added = F.transform(kept, lambda c: F.struct((c["rank"] + len(BASE)).alias("rank"), c["start"].alias("start"), c["end"].alias("end"), F.get(names, c["rank"]).alias("kind")))
    empty = F.array().cast("array<struct<rank:int,start:int,end:int,kind:string>>")
    return got.select("doc_id", F.sort_array("base").alias("base"), F.when(F.size("candidates") > 0, F.sort_array(added)).otherwise(empty).alias("added"))


def op5_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda i, k: F.size(F.filter("base", lambda s: s["rank"] == i)).cast("long").alias(f"n_{k}")
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), *(count(i, k) for i, k in enumerate(BASE)), F.sha2(S.listed(F.col("base")), 256).alias("base_sha256"), S.listed(F.concat("base", "added")).alias("spans"))
