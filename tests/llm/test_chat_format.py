import hashlib

from loomdex.llm import chat_format as C

ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "user", None), (1, 3, "assistant", "<|im_end|>\n␛0 <|im_sep|>␛1"), (1, 4, "assistant", "b"), (1, 5, "user", "é\U0001f600"),
    (2, 0, None, "x"), (2, 0, None, "x"), (2, None, "assistant", "early"), (3, 0, "assi\nstant", "</s>[INST] ok [/INST]"), (None, 0, "user", ""), (4, 0, "assistant", ""), (4, 1, "assistant", "␛" * 3 + "9\n"),
]


def order(r):
    return (r[1] is not None, r[1] or 0, C.SIGN.join([r[2] or ""]), r[3] or "")


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    chats = C.format_chats(df)
    got = {r["conv_id"]: r for r in C.read_back(chats).collect()}
    masks = {r["conv_id"]: r for r in chats.collect()}
    assert got.keys() == {1, 2, 3, 4, None}
    for key, r in got.items():
        want = sorted((x for x in ROWS if x[0] == key), key=order)
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in want]
        assert r["loss_texts"] == [x[3] or "" for x in want if x[2] == "assistant"]
        m = masks[key]
        assert sum(x["chars"] for x in m["mask"]) == len(m["formatted"])
        messages = 1 + sum((a[2] or "") != (b[2] or "") for a, b in zip(want, want[1:]))
        assert m["formatted"].count(C.START) == m["formatted"].count(C.END) == messages and m["formatted"].count(C.SEP) == len(want) - messages


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, formatted string")
    assert C.read_back(C.format_chats(df)).count() == 0


def test_query_digests(spark, sf):
    got = {r["conv_id"]: r for r in C.op2_chat_format(spark, sf).collect()}
    said = "</s>[INST] ok [/INST]"
    r = got[-7]
    assert (r["n_turns"], r["loss_chars"]) == (2, len(said))
    assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
