import hashlib
import random
import re

from pyspark.sql import functions as F

from loomdex.llm import secrets as S

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(s):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(s) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", s) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", s) if len(m.group()) >= 32]
    return [(k, a, b) for a, _, b, k in sorted(out)]


def test_findings_equal_plain_search(spark, docs, odd):
    rng = random.Random(5)
    bits = ["password", "TOKEN", "api_key", "apikey", "=", ": ", '"', "'", " ", "abc", "longvalue123", "AKIA", "AKIAABCDEFGH1234", "é", "\U0001f600", "deadbeef" * 4, "0f" * 15, "token: token", "\n", "secret=secret="]
    texts = odd + ["".join(rng.choice(bits) for _ in range(10)) for _ in range(300)]
    added, back = S.scan(docs(texts), path="doc_id")
    got = {r["path"]: [(f["rule"], f["start"], f["end"]) for f in r["findings"] if f["rule"] in S.BASE] for r in back.collect()}
    for i, t in enumerate(texts):
        assert got[i] == base(t or ""), t
    assert added.select("blob").distinct().count() == len({t or "" for t in texts})


def test_ledger(spark, docs):
    first, _ = S.scan(docs(["token = abcdefgh1", "x"]), path="doc_id")
    later = docs(["token = abcdefgh1", "x", "password=12345678", "x"], [7, 8, 9, 10])
    added, back = S.scan(later, first, path="doc_id")
    assert added.select("blob").distinct().count() == 1
    assert {r["path"] for r in back.collect() if r["findings"]} == {7, 9}
    rules = {**S.RULES, "hex": (2, S.RULES["hex"][1])}
    again, _ = S.scan(later, first.unionByName(added), path="doc_id", rules=rules)
    assert {(r["rule"], r["version"]) for r in again.collect()} == {("hex", 2)} and again.count() == 3
    none, back = S.scan(later, first.unionByName(added), path="doc_id")
    assert none.count() == 0 and back.count() == 4
    assert S.scan(docs([]), path="doc_id")[1].count() == 0


def test_query_equals_plain_search(spark, docs, odd, tmp_path):
    """The registered query's columns, from both steps of its scan, over repeated and null ids too."""
    texts = [*odd, "token = abcdefgh1", "token = abcdefgh1", "x AKIAABCDEFGH1234 " + "0f" * 16, "é secret: 'longvalue123'"]
    ids = [None, *range(1, len(texts) - 1), 1]
    docs(texts, ids).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted((tuple(r)[:6] for r in S.op7_secret_ledger(spark, f"file://{tmp_path}").collect()), key=repr)
    want = []
    for i, t in zip(ids, texts):
        found = base(t or "")
        count = lambda k: sum(x[0] == k for x in found)  # noqa: B023, E731
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
        want.append((i, count("assign"), count("access"), count("hex"), digest))
    assert [x[:5] for x in got] == sorted(want, key=repr)


def test_only_unseen_texts_are_fetched(spark, docs):
    first, _ = S.scan_blobs(docs(["a", "token = abcdefgh1"]))
    for rows in (200_000, 0):
        added, by_blob = S.scan_blobs(docs(["a", "token = abcdefgh1", "password=12345678", "password=12345678"]), first, broadcast_rows=rows)
        assert added.select("blob").distinct().count() == 1 and by_blob.count() == 2


def test_redaction(spark, docs):
    t = "a password=12345678 b AKIAABCDEFGH1234 c"
    _, found = S.scan_blobs(docs([t]))
    got = docs([t]).withColumn("blob", S.address(F.col("text"))).join(found, "blob").select(S.redacted(F.col("text"), F.col("findings")).alias("x")).first()["x"]
    assert got == "a [SECRET] b [SECRET] c"


def pem(rng, kind="RSA ", lines=12, sep="\n", last="QmFzZQ=="):
    body = ["".join(rng.choice("ABCXYZabcxyz0189+/") for _ in range(64)) for _ in range(lines)]
    return [f"-----BEGIN {kind}PRIVATE KEY-----", *body, last], f"-----END {kind}PRIVATE KEY-----", sep


def test_whole_keys_go(spark, docs):
    import corpus_pipeline as P

    rng = random.Random(7)
    texts, want = [], []
    for kind, lines, sep in [("RSA ", 12, "\n"), ("", 1, "\r\n"), ("EC ", 4, "\\n"), ("OPENSSH ", 2000, "\n  "), ("ENCRYPTED ", 3, "\n> ")]:
        parts, end, _ = pem(rng, kind, lines, sep)
        texts += [f"before {sep.join([*parts, end])} after it", f"before {sep.join(parts)}\nafter it, more"]
        want += ["before [SECRET] after it", "before [SECRET]\nafter it, more"]
    parts, end, _ = pem(rng)
    parts.insert(1, "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0011\n")
    whole = "\n".join([*parts, end])
    texts += [f"{whole}\n{whole}", "\n".join(parts) + f"\n{whole} z", "say -----BEGIN PRIVATE KEY----- and go on, no key here", "\n".join([*parts[:-1], "QmFz"]), "\n".join("-" + x for x in [*parts, end])]
    want += ["[SECRET]\n[SECRET]", "[SECRET]\n[SECRET] z", "say [SECRET] and go on, no key here", "[SECRET]", "-[SECRET]"]
    out = {r["doc_id"]: r["text"] for r in P.without_secrets(spark, docs(texts), "").collect()}
    assert [out[i] for i in range(len(texts))] == want
    assert S.RULES["key_block"][0] == 2
