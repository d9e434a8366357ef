import itertools
import math
import random

from pyspark.sql import functions as F

from loomdex.operators import code as C
from loomdex.operators import segment as S

NOTE = "---\na: 1\n---\n# T\ntext\n\n## B\n- x\n- y\n\n```\ncode\n\nmore\n```\n|a|b|\n|c|d|\n***\nfoo\nbar\n\n- one\n\n  cont\n- two\n\nend\n\n```\nopen"


def test_markdown_units():
    got = [(k, a, b) for k, a, b, _ in S.markdown_units(NOTE)]
    assert got == [("frontmatter", 1, 3), ("heading", 4, 5), ("heading", 7, 9), ("code_block", 11, 15), ("table", 16, 17), ("thematic_break", 18, 18), ("paragraph", 19, 20), ("list", 22, 25), ("paragraph", 27, 27), ("paragraph", 29, 30)]
    assert S.markdown_units("  \n ") == []
    assert S.markdown_break(("heading", 1, 2, 2), ("heading", 4, 4, 1)) == 2.75
    assert S.markdown_break(("paragraph", 1, 1, None), ("list", 2, 3, None)) == 0.5
    assert S.markdown_break(("thematic_break", 1, 1, None), ("heading", 5, 5, 1)) == 3.0


def brute(sizes, scores, least, most, weight, reach=15):
    """All cuts, scored outright."""
    n, best = len(sizes), None
    for k in range(1, n + 1):
        for cut in itertools.combinations(range(1, n), k - 1):
            ends = [0, *cut, n]
            parts = [(a, b) for a, b in zip(ends, ends[1:])]
            size = [sum(sizes[a:b]) for a, b in parts]
            if any(b - a > reach or (s < least and b < n) or (s > most and b - a > 1) for s, (a, b) in zip(size, parts)):
                continue
            mean = sum(size) / k
            cv = math.sqrt(max(0, sum(s * s for s in size) / k - mean * mean)) / mean if mean else 0
            value = sum(scores[a - 1] for a, _ in parts if a) / k - weight * cv
            best = value if best is None else max(best, value)
    return best


def test_dynamic_programme():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(2, 7)
        sizes, scores = [rng.randint(10, 900) for _ in range(n)], [rng.choice([0, 0.5, 1.5, 3]) for _ in range(n - 1)]
        got = S.segments(sizes, scores, 200, 1200, 0.3)
        assert [a for a, _ in got] == [0, *(b + 1 for _, b in got[:-1])] and got[-1][1] == n - 1
        size = [sum(sizes[a : b + 1]) for a, b in got]
        mean = sum(size) / len(size)
        cv = math.sqrt(max(0, sum(s * s for s in size) / len(size) - mean * mean)) / mean
        value = sum(scores[a - 1] for a, _ in got if a) / len(got) - 0.3 * cv
        want = brute(sizes, scores, 200, 1200, 0.3)
        assert want is None and len(got) == 1 or want is not None and value <= want + 1e-9
    assert S.segments([], []) == [] and S.segments([5], []) == [(0, 0)]
    assert S.segments([300] * 6, [0, 2, 0, 0, 1], 200, 800, 0.3) == [(0, 1), (2, 3), (4, 5)]


def test_line_budget():
    text = "\n".join(f"line {i} " + "x" * 20 for i in range(60))
    got = list(S.line_budget(text, "p", 40, 10))
    assert all(len(g[2]) + 1 <= 160 for g in got) and got[0][3] == 1 and got[-1][4] == 60
    assert all(b[3] <= a[4] for a, b in zip(got, got[1:]))
    assert [g[2] for g in S.line_budget("y" * 300, "p", 32, 0)] == ["y" * 128, "y" * 128, "y" * 44]


def test_code_pieces():
    java = "package a;\n" + "import b;\n" * 5 + "public class A {\n    int x = 1;\n    public int run(int y) {\n        return x + y;\n    }\n}\n\nenum E {\n    ONE_VALUE, TWO_VALUE\n}\n"
    assert [(t, a) for t, _, a, _ in S.code_pieces(java, "A.java")] == [("class A", 7), ("enum E", 14)]
    py = "import os\n\n@dec\ndef f(x):\n    y = x\n    return y\n\nclass K:\n    pass\n\ndef tiny(): return 1\n"
    assert [(t, a, b) for t, _, a, b in S.code_pieces(py, "m.py")] == [("def f", 3, 6), ("class K", 8, 9)]
    assert S.code_pieces("def (:\n", "bad.py")[0][0] == "bad.py"
    sh = "#!/bin/sh\n" * 8 + "function build {\n  echo building now\n}\nrun() {\n  echo running here\n}\n"
    assert [t for t, *_ in S.code_pieces(sh, "x.sh")] == ["function build", "function run"]
    long = "\n".join("" if i % 90 == 89 else f"row {i}" for i in range(400))
    got = S.by_size(long, "d/t.txt")
    assert got[0][0] == "t.txt:1" and got[0][3] == 89 and got[1][2] == 91 and got[-1][3] == 400
    ts = "// c\n" * 9 + "export interface Aa {\n  x: number;\n}\nconst a = 1234567890;\nconst b = 1234567891;\nexport function go() {\n  return 1;\n  // one\n  // two\n  // three\n}\n"
    assert [t for t, *_ in S.code_pieces(ts, "x.ts")][0].startswith("interface Aa")


def test_relational_chunks(spark):
    rows = spark.createDataFrame([("n.md", "intro\n## One\na\n## Two\nb\n\n## \n")], "file_path string, content string")
    got = S.by_heading(rows).orderBy("chunk_index").collect()
    assert [(r["title"], r["start_line"], r["end_line"]) for r in got] == [("n.md", 1, 1), ("One", 2, 3), ("Two", 4, 6), ("", 7, 8)]
    plain = S.plain_chunks(rows.withColumn("content", F.lit("a" * 1000 + "\n\n" + "b" * 700 + "\n\nc")), most=1600).orderBy("chunk_index").collect()
    assert [len(r["content"]) for r in plain] == [1000, 703] and plain[1]["start_line"] == 2
    turns = spark.createDataFrame([(1, 0, "assistant", "early"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "assistant", "a2"), (1, 4, "user", " "), (1, 5, "user", "btw /x/y/z.py?")], "conv_id long, turn long, role string, text string")
    ex = S.exchanges(turns)
    assert {(r["user"], r["assistant"]) for r in ex.collect()} == {("u1", "a1\n\na2"), ("btw /x/y/z.py?", "")}
    assert [r["score"] for r in S.boundary_scores(ex).collect()] == [1.5]
    assert S.exchange_chunks(ex, 20).count() == 2 and S.exchange_chunks(ex).count() == 1


def test_imports_and_symbols():
    ts = "import a, {b} from 'x';\nimport * as n from \"./n\";\nimport {c} from '@/c';\nimport 'side';\nexport * from './e';\nconst r = require('q');\n"
    assert [(n, k) for n, k, _ in C.imports_of(ts, "m.ts")] == [("x", "default_import"), ("./n", "namespace_import"), ("@/c", "import"), ("side", "side_effect"), ("./e", "reexport"), ("q", "require")]
    py = "import os.path\nfrom . import k\nfrom a.b import c as d\nfrom z import *\nclass A(B[int], m.C):\n    def f(self):\n        self.g(1)\n"
    assert [(n, k) for n, k, _ in C.imports_of(py, "m.py")] == [("os.path", "import"), (".k", "import"), ("a.b.c", "import"), ("z", "wildcard_import")]
    assert [(n, k) for n, k, *_ in C.symbols_of(py, "m.py")] == [("A", "class"), ("A.f", "method")]
    assert [(c, p) for c, p, *_ in C.hierarchy_of(py, "m.py")] == [("A", "B"), ("A", "m.C")]
    assert [(c, r) for c, r, _ in C.calls_of(py, "m.py")] == [("g", "self")]
    assert list(C.imports_of("import static a.B.c;\nimport x.*;\n// import no.No;\n", "A.java")) == [("a.B.c", "static_import", 1), ("x", "wildcard_import", 2)]
    kt = "class A(val b: B) : Base<Int>(b), Face, Other by b {\n  fun run() { b.go() }\n}\nobject O\n"
    assert [(p, k) for _, p, k, _ in C.hierarchy_of(kt, "A.kt")] == [("Base", "extends"), ("Face", "implements"), ("Other", "delegation")]
    assert [(n, k) for n, k, *_ in C.symbols_of(kt, "A.kt")] == [("A", "class"), ("A.run", "method"), ("O", "object")]


def test_build_files():
    rows = lambda t, p: [(g, a, v, s, i) for g, a, v, s, i, *_ in C.builds_of(t, p)]
    assert rows('implementation("com.google.guava:guava:31.1")', "build.gradle.kts") == [("com.google.guava", "guava", "31.1", "implementation", False)]
    assert list(C.builds_of('implementation(project(":core:common"))', "build.gradle.kts"))[0][4:] == (True, ":core:common", "project::core:common")
    assert rows("api 'a:b:1'\nimplementation group: 'g', name: 'n', version: '2'\ntestImplementation project(':m')", "build.gradle") == [("", ":m", "", "testImplementation", True), ("a", "b", "1", "api", False), ("g", "n", "2", "implementation", False)]
    pom = "<project><properties><v>1.2</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version><scope>test</scope></dependency></dependencies></project>"
    assert rows(pom, "pom.xml") == [("g", "a", "1.2", "test", False)]
    assert rows('[project]\ndependencies = ["requests>=2.0", "x[y]; python_version>\'3\'"]', "pyproject.toml") == [("", "requests", "2.0", "runtime", False), ("", "x", "", "runtime", False)]
    assert rows("# c\n-r other\nflask==1.0\n", "requirements-dev.txt") == [("", "flask", "1.0", "runtime", False)]
    assert rows('{"dependencies": {"@s/a": "^1"}, "devDependencies": {"b": "workspace:x"}}', "package.json") == [("@s", "a", "^1", "runtime", False), ("", "b", "workspace:x", "dev", True)]
    assert [r[1] for r in rows('include(":a", ":b")', "settings.gradle.kts")] == [":a", ":b"]
    assert rows("not json", "package.json") == rows("<x", "pom.xml") == rows("= bad", "pyproject.toml") == []


def test_tool_modes_and_boundary_signals(spark):
    modes = [("Read", "read"), ("Edit", "write"), ("own__search", "read"), ("own__write", "write"), ("other__write", "none"), ("Other", "none")]
    rows = spark.createDataFrame([(i, [t]) for i, (t, _) in enumerate(modes)] + [(9, ["Read", "Write"]), (10, None)], "id long, tools array<string>")
    got = {r["id"]: r["m"] for r in rows.select("id", S.tool_mode(F.col("tools"), (*S.READ_TOOLS, "own__search"), (*S.WRITE_TOOLS, "own__write")).alias("m")).collect()}
    assert [got[i] for i in range(len(modes))] == [m for _, m in modes] and got[9] == "mixed" and got[10] == "none"
    x = spark.createDataFrame([(1, 1, "look at /a/b/c.py", "", ["Read"], "2025-01-01 00:00:00"), (1, 2, "fix /d/e/f.py", "", ["Edit"], "2025-01-01 00:02:00"), (1, 3, "really?", "", [], "2025-01-01 00:02:10"), (1, 4, "now let's switch to x", "", [], "2025-01-01 01:00:00")], "conv_id long, exchange long, user string, assistant string, tools array<string>, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r["score"] for r in S.boundary_scores(x).orderBy("exchange").collect()] == [2.5, 0.25, 2.5]
