"""Chat formatting by relational steps alone.

Turn structs are collected and sorted per conversation, adjacent turns of one role share a message, and the
string is concatenated by Spark expressions. The template:

    <|im_start|>ROLE\\n TEXT [<|im_sep|> TEXT ...] <|im_end|>\\n   for each message

Control strings inside texts and roles are escaped: the escape sign becomes sign+"0", each control string
becomes sign+digit, and a role's line feed becomes sign+"9". No escaped text holds a control string, so
`read_back` recovers each turn exactly.

The loss mask is run-length coded: `mask` holds (chars, loss) runs that cover `formatted` in order.

Cases. Null text and null role count as empty. Rows are put in the order (turn, role, text), nulls first, so ties and
repeated rows have one order and each row is a turn. A null conv_id is a conversation of its own. An empty
table gives no rows. Other columns are not read. A conversation's turns are one output value by definition;
that is the only grouping, and its size is that value's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import spans as S

SIGN = "␛"
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: In the order of their digits, from 1.
CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "</s>", "<s>", "[/INST]", "[INST]")


def escaped(x: Column) -> Column:
    x = F.replace(x, F.lit(SIGN), F.lit(SIGN + "0"))
    for i, c in enumerate(CONTROLS, 1):
        x = F.replace(x, F.lit(c), F.lit(f"{SIGN}{i}"))
    return x


def unescaped(x: Column) -> Column:
    for i, c in enumerate(CONTROLS, 1):
        x = F.replace(x, F.lit(f"{SIGN}{i}"), F.lit(c))
    return F.replace(x, F.lit(SIGN + "0"), F.lit(SIGN))


def escaped_role(x: Column) -> Column:
    return F.replace(escaped(x), F.lit("\n"), F.lit(SIGN + "9"))


def unescaped_role(x: Column) -> Column:
    return unescaped(F.replace(x, F.lit(SIGN + "9"), F.lit("\n")))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, mask (array of (chars, loss)) for each conversation; one shuffle, by conversation."""
    row = F.struct(F.col(turn).alias("turn"), escaped_role(F.coalesce(F.col(role).cast("string"), F.lit(""))).alias("role"), escaped(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))
    got = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def lead(x: Column, i: Column) -> Column:
        """What stands before a turn: a separator inside a message, else the last one's end and this one's start."""
        before = F.get(F.col("turns"), i - 1)["role"]
        opened = F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), x["role"], F.lit("\n"))
        return F.when((i > 0) & (before == x["role"]), F.lit(SEP)).otherwise(opened)

    got = got.withColumn("pieces", F.transform("turns", lambda x, i: F.struct(lead(x, i).alias("lead"), x["text"].alias("text"), (x["role"] == loss_role).alias("loss"))))
    joined = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["text"])), ""), F.lit(END))
    run = lambda n, loss: F.struct(F.length(n).alias("chars"), loss.alias("loss"))
    mask = F.concat(F.flatten(F.transform("pieces", lambda p: F.array(run(p["lead"], F.lit(False)), run(p["text"], p["loss"])))), F.array(run(F.lit(END), F.lit(False))))
    return got.select("conv_id", joined.alias("formatted"), mask.alias("mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array of (role, text)) and loss_texts, from the formatted string and its mask alone."""
    message = F.filter(F.split("formatted", r"\Q" + END + r"\E", -1), lambda m: m != "")
    body = F.transform(message, lambda m: F.struct(unescaped_role(F.substring_index(F.substr(m, F.lit(len(START) + 1)), "\n", 1)).alias("role"), F.split(F.substr(m, F.instr(m, "\n") + 1), F.lit(r"\Q" + SEP + r"\E"), F.lit(-1)).alias("texts")))
    turns = F.flatten(F.transform(body, lambda m: F.transform(m["texts"], lambda t: F.struct(m["role"].alias("role"), unescaped(t).alias("text")))))
    # Where each run ends, and the text under those that count, cut from blocks: a long conversation costs what its text is long.
    ends = S.running(F.transform("mask", lambda m: m["chars"]), lambda a, b: a + b)
    runs = F.filter(F.arrays_zip(F.col("mask").alias("m"), ends.alias("end")), lambda r: r["m"]["loss"])
    under = S.let(S.blocks(F.col("formatted")), lambda parts: F.transform(runs, lambda r: S.cut(parts, r["end"] - r["m"]["chars"], r["end"])))
    return chats.select("conv_id", "formatted", turns.alias("turns"), F.transform(under, unescaped).alias("loss_texts"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = read_back(format_chats(rows.unionByName(extra)))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_sql() -> str:
    text = f"replace(coalesce(text, ''), '{SIGN}', '{SIGN}0')"
    role = f"replace(coalesce(role, ''), '{SIGN}', '{SIGN}0')"
    for i, c in enumerate(CONTROLS, 1):
        text, role = (f"replace({x}, '{c}', '{SIGN}{i}')" for x in (text, role))
    role = f"replace({role}, chr(10), '{SIGN}9')"
    return f"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, {role} AS erole, {text} AS etext,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {role}, {text}) AS n FROM rows),
u AS (SELECT *, coalesce(lag(erole) OVER (PARTITION BY conv_id ORDER BY n) = erole, false) AS same FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY n)) AS loss_sha256,
  sum(length(etext) + CASE WHEN same THEN {len(SEP)} ELSE {len(START) + 1 + len(END)} + length(erole) END)::BIGINT AS formatted_chars
FROM u GROUP BY conv_id"""
