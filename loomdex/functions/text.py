"""Text, date and title functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- tokens -------------------------------------------------------------------------------------


def _folding() -> tuple[str, str]:
    """Latin letters with marks, and their base letters, by decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folding()


def tokens(text: Column) -> Column:
    """Index tokens: lower case, marks of Latin letters removed, runs of letters and digits."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), FOLD_FROM, FOLD_TO), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def words(text: Column) -> Column:
    """Different lower-case words, underscores included."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def rough_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


def content_hash(text: Column, full: bool = False) -> Column:
    digest = F.sha2(text.cast("binary"), 256)
    return digest if full else F.substr(digest, F.lit(1), F.lit(16))


def chunk_id(path: Column, index: Column) -> Column:
    return F.concat_ws(":", path, index.cast("string"))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# ---- display ------------------------------------------------------------------------------------


def last_place(text: Column, what: str) -> Column:
    """0-based place of the last occurrence; -1 without one."""
    back = F.instr(F.reverse(text), what[::-1])
    return F.when(back > 0, F.length(text) - back - len(what) + 1).otherwise(-1)


def smart_truncate(text: Column, most: int = 800) -> Column:
    """Cut at the last paragraph, sentence or word break past 60 % of the limit, else at the limit."""
    head = F.substr(text, F.lit(1), F.lit(most))
    floor = most * 0.6
    paragraph = last_place(head, "\n\n")
    sentence = F.greatest(last_place(head, ". "), last_place(head, ".\n"))
    space = last_place(head, " ")
    cut = lambda n: F.substr(head, F.lit(1), n)
    return F.when(F.length(text) <= most, text).when(paragraph > floor, cut(paragraph)).when(sentence > floor, cut(sentence + 1)).when(space > floor, cut(space)).otherwise(head)


def snippet(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(most)), F.lit("..."))).otherwise(text)


def display_path(path: Column) -> Column:
    """A conversation's last segment without its extension; other paths as they are."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.jsonl$", "")
    return F.when(source_kind(path) == "conversations", name).otherwise(path)


# ---- names and titles ---------------------------------------------------------------------------


def source_kind(path: Column) -> Column:
    return F.when(path.startswith("conversations/"), "conversations").when(path.startswith("codebase:") | path.startswith("codebase/"), "codebase").otherwise("curated")


def normalize_project(raw: Column, user: str | None = None) -> Column:
    """Without the home folder's prefix, in lower case. `user`: the home folder's name; any one without it."""
    name = r"\Q" + user.replace(".", "-") + r"\E" if user else r"[^/\\-]+"
    return F.lower(F.regexp_replace(F.regexp_replace(raw, rf"(?i)^-*Users-{name}-", ""), r"^[-/\\]+", ""))


def title_parts(title: Column) -> Column:
    return F.transform(F.split(title, r" \| "), lambda s: F.trim(s))


def title_project(title: Column) -> Column:
    fits = lambda s: ~s.startswith("Tools: ") & ~s.rlike(r"^\d{4}-\d{2}-\d{2}$") & (s != "")
    return F.get(F.filter(title_parts(title), fits), F.lit(0))


def title_date(title: Column) -> Column:
    """The last segment that is a date."""
    found = F.filter(title_parts(title), lambda s: s.rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def title_tools(title: Column) -> Column:
    found = F.filter(title_parts(title), lambda s: s.startswith("Tools: "))
    listed = F.filter(F.transform(F.split(F.substr(F.get(found, F.lit(0)), F.lit(8)), ","), lambda s: F.trim(s)), lambda t: t != "")
    return F.coalesce(listed, F.array().cast("array<string>"))


def extract_title(content: Column, path: Column) -> Column:
    """The first heading, else the file's stem."""
    heading = strip(F.regexp_extract(content, r"(?m)^#+\s+(.+)$", 1))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.when(heading != "", heading).otherwise(stem)


def session_title(project: Column, first_user: Column) -> Column:
    return F.concat(project, F.lit(" — "), F.substr(first_user, F.lit(1), F.lit(80)))


def exchange_title(project: Column, date: Column, tools: Column) -> Column:
    tail = F.when(F.size(tools) > 0, F.concat(F.lit("Tools: "), F.array_join(tools, ", ")))
    return F.concat_ws(" | ", project, date, tail)


def index_path(path: Column) -> Column:
    """conversations/<project>/<name> by the segment after `projects`, else by the parent folder."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "projects")
    project = F.when((at > 0) & (at < F.size(parts) - 1), F.element_at(parts, (at + 1).cast("int"))).otherwise(F.try_element_at(parts, F.lit(-2)))
    return F.concat(F.lit("conversations/"), F.coalesce(project, F.lit("")), F.lit("/"), F.element_at(parts, -1))


def archive_path(name: Column) -> Column:
    """project_uuid[_date].jsonl to conversations/project/uuid.jsonl; null for other names."""
    uuid = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    whole = rf"^(.*)_({uuid})(?:_.*)?\.jsonl$"
    return F.when(name.rlike(whole), F.concat(F.lit("conversations/"), F.regexp_extract(name, whole, 1), F.lit("/"), F.regexp_extract(name, whole, 2), F.lit(".jsonl")))


def is_uuid(text: Column) -> Column:
    return text.rlike(r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def safe_path(path: Column) -> Column:
    """Relative, without a step up, ending in .md."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..") & path.endswith(".md")


def indexable(path: Column, extensions: tuple[str, ...] = (".py", ".java", ".kt", ".kts", ".ts", ".tsx", ".js", ".jsx", ".sh", ".md")) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1).isin(*extensions)


# ---- dates --------------------------------------------------------------------------------------

# Month names.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
ISO = r"(?<![\p{L}\p{N}_])(\d{4}-\d{2}-\d{2})(?![\p{L}\p{N}_])"
ENGLISH = rf"(?i)(?<![\p{{L}}\p{{N}}_])((?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}})(?![\p{{L}}\p{{N}}_])"
RELATIVE = r"(?i)(?<![\p{L}\p{N}_])(yesterday|today|last\s+(?:week|month|monday|tuesday|wednesday|thursday|friday|saturday|sunday)|this\s+(?:week|month))(?![\p{L}\p{N}_])"


def day(text: Column) -> Column:
    return F.try_to_date(text, "yyyy-MM-dd")


def date_from_path(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def english_day(found: Column) -> Column:
    plain = F.initcap(F.regexp_replace(F.regexp_replace(found, ",", " "), r"\s+", " "))
    return F.try_to_date(plain, "MMMM d yyyy")


def relative_day(found: Column, anchor: Column) -> Column:
    """Fixed meanings, counted back from the anchor."""
    plain = F.lower(F.regexp_replace(found, r"\s+", " "))
    name = F.regexp_extract(plain, r"^last (\w+day)$", 1)
    before = F.call_function("next_day", F.date_sub(anchor, 8), F.initcap(F.substr(name, F.lit(1), F.lit(3))))
    return (
        F.when(plain == "yesterday", F.date_sub(anchor, 1))
        .when(plain.isin("today", "this week", "this month"), anchor)
        .when(plain == "last week", F.date_sub(anchor, 7))
        .when(plain == "last month", F.add_months(anchor, -1))
        .when(name != "", before)
    )


def session_day(ts: Column) -> Column:
    """ISO prefix, or epoch seconds or milliseconds, in UTC."""
    number = F.when(ts.rlike(r"^[0-9.]+$"), ts.try_cast("double"))
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    return F.when(number.isNotNull(), F.timestamp_seconds(seconds).cast("date")).otherwise(day(F.substr(ts, F.lit(1), F.lit(10))))


def event_date(content: Column, session_ts: Column, path: Column, as_of: Column) -> Column:
    """Session time, then the path's date, then an ISO, an English and a relative date in the text."""
    first = lambda pattern: F.nullif(F.regexp_extract(content, pattern, 1), F.lit(""))
    return F.coalesce(session_day(session_ts), day(date_from_path(path)), day(first(ISO)), english_day(first(ENGLISH)), relative_day(first(RELATIVE), as_of))


def query_date(query: Column, as_of: Column) -> Column:
    """ISO, then "Month day, year", then "Month year" (its 15th), then relative words."""
    first = lambda pattern: F.nullif(F.regexp_extract(query, pattern, 1), F.lit(""))
    month = F.initcap(F.regexp_replace(first(rf"(?i)(?<![\p{{L}}\p{{N}}_])((?:{MONTHS})\s+\d{{4}})(?![\p{{L}}\p{{N}}_])"), r"\s+", " "))
    return F.coalesce(day(first(ISO)), english_day(first(ENGLISH)), F.date_add(F.try_to_date(month, "MMMM yyyy"), 14), relative_day(first(RELATIVE), as_of))


def gap_seconds(before: Column, after: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.unix_timestamp(after) - F.unix_timestamp(before)), F.lit(0))


# ---- rendering and parsing of model text --------------------------------------------------------


def exchange_text(user: Column, assistant: Column) -> Column:
    return F.concat(F.lit("User: "), user, F.when(F.coalesce(assistant, F.lit("")) != "", F.concat(F.lit("\n\nAssistant: "), assistant)).otherwise(F.lit("")))


def transcript(exchanges: Column, most: int = 30_000) -> Column:
    """Rendered exchanges (array of (user, assistant)), cut with a marker."""
    text = F.array_join(F.transform(exchanges, lambda e: exchange_text(e["user"], e["assistant"])), "\n\n---\n\n")
    return F.when(F.length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(most)), F.lit("\n\n[... truncated ...]"))).otherwise(text)


def with_boundaries(exchanges: Column) -> Column:
    marked = F.transform(exchanges, lambda e, i: F.concat(F.when(i > 0, F.concat(F.lit("<<<BOUNDARY_"), (i - 1).cast("string"), F.lit(">>>\n\n"))).otherwise(F.lit("")), exchange_text(e["user"], e["assistant"])))
    return F.array_join(marked, "\n\n")


def judge_score(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)SCORE:\s*(\d+(?:\.\d+)?)\s*(?:/\s*10)?", 1), F.lit("")).cast("double")


def judge_feedback(text: Column) -> Column:
    return strip(F.regexp_extract(text, r"(?is)FEEDBACK:\s*(.*)$", 1))


def without_fences(text: Column) -> Column:
    inside = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    return strip(F.when(text.rlike("```"), F.when(inside != "", inside).otherwise(text)).otherwise(text))


def html_to_text(html: Column) -> Column:
    """Blocks that hold no prose go, tags become spaces, white space is folded."""
    text = html
    for tag in ("script", "style", "nav", "header", "footer", "noscript"):
        text = F.regexp_replace(text, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# What an exchange without content begins with, and what it holds where nobody answers.
NOISE_OPENINGS = ("Edit operation feedback", "Write operation feedback")
NOISE_PARTS = ("Base directory for this skill", "local-command-caveat", "PreToolUse")


def is_noise(user: Column, assistant: Column, openings: tuple[str, ...] = NOISE_OPENINGS, parts: tuple[str, ...] = NOISE_PARTS) -> Column:
    """The user's text, as it is, begins with a known opening; or the answer is blank and the text holds a known part."""
    said, unanswered = F.coalesce(user, F.lit("")), strip(F.coalesce(assistant, F.lit(""))) == ""
    opens, holds = F.lit(False), F.lit(False)
    for x in openings:
        opens = opens | said.startswith(x)
    for x in parts:
        holds = holds | said.contains(x)
    return opens | (unanswered & holds)


def scip_edge_type(symbol: Column) -> Column:
    return F.when(symbol.contains("("), "calls").when(symbol.contains("#"), "extends").otherwise("import")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def directory_distance(a: Column, b: Column) -> Column:
    """Steps up and down between two files' folders."""
    parts = lambda p: F.filter(F.split(directory(p), "/"), lambda x: x != "")
    x, y = parts(a), parts(b)
    same = F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    return F.size(x) + F.size(y) - 2 * same
