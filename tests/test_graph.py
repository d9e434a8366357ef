from pyspark.sql import functions as F

from loomdex.operators import graph as G

EDGE = "id long, codebase string, source_file string, target_file string, edge_type string, metadata string, updated_at long"


def edges(spark, rows):
    return spark.createDataFrame([(i, "repo", a, b, k, m, 1000) for i, (a, b, k, m) in enumerate(rows)], EDGE)


CHAIN = [("A.java", "B.java", "calls", None), ("B.java", "C.java", "calls", None), ("C.java", "D.java", "calls", None), ("A.java", "E.java", "extends", None), ("D.java", "A.java", "calls", None)]


def start(spark, f):
    return spark.createDataFrame([("repo", f)], "codebase string, file string")


def test_reach_and_paths(spark):
    e = edges(spark, CHAIN)
    got = {r["file"]: r["depth"] for r in G.reach(e, start(spark, "A.java")).collect()}
    assert got == {"B.java": 1, "E.java": 1, "C.java": 2, "D.java": 3}
    assert {r["file"] for r in G.reach(e, start(spark, "A.java"), edge_types=["calls"]).collect()} == {"B.java", "C.java", "D.java"}
    assert {r["file"] for r in G.reach(e, start(spark, "C.java"), "upstream", max_depth=1).collect()} == {"B.java"}
    assert G.reach(e, start(spark, "nope")).count() == 0
    ways = {r["file"]: r["path"] for r in G.paths(e, "A.java").collect()}
    assert ways["D.java"] == ["A.java", "B.java", "C.java", "D.java"] and "A.java" not in ways
    symbols = spark.createDataFrame([("repo", "A.java", "Alpha")], "codebase string, file_path string, name string")
    got = G.graph_traverse(e, symbols, "Alpha", include_paths=True, max_results=3).collect()
    assert len(got) == 3 and got[0]["path"] == ["A.java", "B.java"]


def clusters(spark):
    rows = []
    for c in range(3):
        for i in range(1, 10):
            rows.append((f"c{c}/f0.java", f"c{c}/f{i}.java", ("calls", "import", "extends")[i % 3], None))
            rows.append((f"c{c}/f{i}.java", f"c{c}/f{i % 9 + 1}.java", "calls", None))
    rows += [(f"c{b % 3}/f1.java", f"c{(b + 1) % 3}/f2.java", "import", None) for b in range(3)]
    return edges(spark, rows)


def test_communities(spark):
    e = clusters(spark)
    found = G.communities(e)
    label = {r["file_path"]: r["community_id"] for r in found.collect()}
    assert all(len({label[f"c{c}/f{i}.java"] for i in range(10)}) == 1 for c in range(3)) and len(set(label.values())) == 3
    assert found.first()["modularity"] > 0.5
    assert G.bridges(e, found).count() == 3
    best = G.community_list(e, found).collect()
    assert len(best) == 3 and all(r["members"] == 10 and len(r["top_files"]) == 3 for r in best)
    assert G.community_members(e, found, "repo", "c0/f0.java").count() == 10
    assert G.community_meta(e, found).first()["community_count"] == 3
    assert G.communities(e.limit(0)).count() == 0


def test_cross_repository(spark):
    e = edges(spark, [("build.gradle", None, "build_dependency", "com.acme:acme-common:1.0"), ("X.java", None, "extends", "com.unknown.NoSuchClass"), ("Y.java", None, "extends", "com.x.Known"), ("pom.xml", None, "build_dependency", "g::1")])
    names = spark.createDataFrame([("acme-common",), ("acme-common-extra",)], "codebase string")
    got = G.resolve_dependencies(e, names).collect()
    assert [(r["source_file"], r["target_file"]) for r in got] == [("build.gradle", "codebase:acme-common/")]
    symbols = spark.createDataFrame([("lib", "k/Known.java", "Known", 1), ("repo", "own/Known.java", "Known", 1)], "codebase string, file_path string, name string, start_line int")
    assert [(r["source_file"], r["target_file"], r["target_codebase"]) for r in G.resolve_types(e, symbols).collect()] == [("Y.java", "k/Known.java", "lib")]
    assert [(r["source_file"], r["target_file"]) for r in G.resolve_hierarchy(e, symbols).collect()] == [("Y.java", "own/Known.java")]


def test_call_cascade(spark):
    calls = spark.createDataFrame([(1, "m/a.java", "go", "Tool"), (2, "m/a.java", "near", ""), (3, "m/a.java", "only", ""), (4, "m/a.java", "twice", ""), (5, "m/a.java", "fetchUsers", ""), (6, "m/a.java", "zzz", ""), (7, "m/a.java", "Suffix", "")], "call_id long, source_file string, callee string, receiver string")
    imports = spark.createDataFrame([("m/a.java", "Tool", "lib/Tool.java"), ("m/a.java", "x.y.Suffix", "lib/S.java")], "source_file string, name string, target_file string")
    symbols = spark.createDataFrame([("near", "m/b.java"), ("near", "q/c.java"), ("only", "z/only.java"), ("twice", "m2/x.java"), ("twice", "m/sub/x.java"), ("fetchUser", "u/f.java")], "short string, file_path string")
    got = {r["call_id"]: (r["strategy"], r["target_file"], r["edge_type"]) for r in G.resolve_calls(calls, imports, symbols).collect()}
    assert got[1] == ("import_exact", "lib/Tool.java", "calls")
    assert got[2] == ("same_module", "m/b.java", "calls")
    assert got[3] == ("unique_name", "z/only.java", "calls")
    assert got[4] == ("nearest", "m/sub/x.java", "calls")
    assert got[5] == ("fuzzy", "u/f.java", "calls")
    assert got[6] == ("none", None, "calls_unresolved")
    assert got[7] == ("import_suffix", "lib/S.java", "calls")


def test_load_graph(spark):
    e = edges(spark, CHAIN).withColumn("updated_at", F.col("id")).unionByName(edges(spark, [("p.gradle", None, "build_dependency", "x")]))
    got, n = G.load_graph(e, most=2)
    assert n == 5 and {r["id"] for r in got.collect()} == {3, 4} and G.load_graph(e)[0].count() == 5 and G.load_graph(e, codebase="other")[1] == 0


def test_lookups(spark):
    e = edges(spark, [*CHAIN, ("p.gradle", None, "build_dependency", "org:My_Lib:1"), ("r", "org:core:2", "repo_dependency", "org:core:2")])
    names = lambda d, f, **k: {r["source_file"] for r in G.dependency_search(e, f, direction=d, **k).collect()}
    assert names("imported_by", "A.java") == {"D.java"} and names("depended_on_by", "my_lib") == {"p.gradle"}
    assert names("repo_depended_on_by", "core") == {"r"} and names("repo_depends_on", "repo") == {"r"}
    assert {r["target_file"] for r in G.dependency_search(e, "A.java", "repo").collect()} == {"B.java", "E.java"}
    symbols = spark.createDataFrame([("1", "repo", "src/core/Service.java", "Service", 1), ("2", "repo", "src/main/Application.java", "App", 1), ("3", "repo", "u/Helper.java", "Helper", 1)], "id string, codebase string, file_path string, name string, start_line int")
    many = edges(spark, [(f"x{i}", "src/core/Service.java", "calls", None) for i in range(7)] + [("y", "u/Helper.java", "calls", None)])
    assert {r["name"] for r in G.high_value(symbols, many, "repo", 5).collect()} == {"Service", "App"}
    stored = spark.createDataFrame([("repo", 8), ("gone", 0)], "codebase string, edge_count long")
    assert {r["codebase"]: r["stale"] for r in G.drifted(stored, many).collect()} == {"repo": False, "gone": False}


def test_symbol_index(spark):
    def index(*docs):
        return spark.createDataFrame([(list(docs),)], "documents array<struct<relativePath:string,occurrences:array<struct<symbol:string,symbolRoles:int>>>>")

    got = G.index_edges(index(("src/Service.java", [("a#doWork().", 1)]), ("src/Controller.java", [("a#doWork().", 0)]))).collect()
    assert [(r["source_file"], r["target_file"], r["edge_type"], r["confidence"]) for r in got] == [("src/Controller.java", "src/Service.java", "calls", 0.95)]
    assert G.index_edges(index(("a.java", [("s#", 1), ("s#", 0)]))).count() == 0


def test_imports_by_roots_and_aliases(spark):
    files = ["app/src/main/java/com/x/Foo.java", "lib/src/main/kotlin/com/x/Bar.kt", "lib/src/main/java/com/x/Foo.java", "pyproject.toml", "pkg/mod.py", "pkg/sub/__init__.py", "src/tool.py", "web/a.ts", "web/b/index.tsx", "src/ui/c.tsx", "lib2/d.js", "one.ts", "tsconfig.json", "src/e.ts"]
    config = '{"compilerOptions": {"baseUrl": "", "paths": {"@ui/*": ["nowhere/*", "src/ui/*"], "one": ["one"], "@/bad/*": ["lib2/*"]}}}'
    rows = spark.createDataFrame([(f, config if f == "tsconfig.json" else "") for f in files], "file_path string, content string")
    asked = [
        ("X.java", "com.x.Foo", "java", "app/src/main/java/com/x/Foo.java"),
        ("X.java", "com.x.Foo.member", "java", "app/src/main/java/com/x/Foo.java"),
        ("X.java", "com.x.Bar", "java", "lib/src/main/kotlin/com/x/Bar.kt"),
        ("X.java", "com.y.Foo", "java", None),
        ("p.py", "pkg.mod", "python", "pkg/mod.py"),
        ("p.py", "pkg.mod.name", "python", "pkg/mod.py"),
        ("p.py", "pkg.sub", "python", "pkg/sub/__init__.py"),
        ("p.py", "tool", "python", "src/tool.py"),
        ("p.py", ".mod", "python", None),
        ("web/b/x.ts", "../a", "typescript", "web/a.ts"),
        ("web/b/x.ts", "./../b", "typescript", "web/b/index.tsx"),
        ("web/x.ts", "../../a", "typescript", None),
        ("web/x.ts", "@ui/c", "typescript", "src/ui/c.tsx"),
        ("web/x.ts", "one", "typescript", "one.ts"),
        ("web/x.ts", "@/e", "typescript", "src/e.ts"),
        ("web/x.ts", "@/bad/e", "typescript", None),
        ("web/x.ts", "@/bad/d", "typescript", "lib2/d.js"),
        ("web/x.ts", "react", "typescript", None),
    ]
    imports = spark.createDataFrame([x[:3] for x in asked], "source_file string, name string, language string")
    got = {(r["source_file"], r["name"]): r["target_file"] for r in G.import_candidates(rows, imports, rows).collect()}
    for source, name, _, want in asked:
        assert got.get((source, name)) == want, name


def test_tables_of_names_and_dependencies(spark):
    rows = [(1, "r", "a.java", "x/T.java", "import", "p.T"), (2, "r", "a.java", "y/T.java", "import", "q.T"), (3, "r", "a.java", "z/Z.java", "wildcard_import", "z.*"), (4, "r", "a.java", None, "import", "n.N"), (5, "r", "b", "g:a", "repo_dependency", "g:a"), (6, "s", "b", "g:b", "repo_dependency", "g:b")]
    e = spark.createDataFrame(rows, "id long, codebase string, source_file string, target_file string, edge_type string, metadata string")
    got = {(r["source_file"], r["name"]): r["target_file"] for r in G.import_map(e).collect()}
    assert got == {("a.java", "p.T"): "x/T.java", ("a.java", "q.T"): "y/T.java", ("a.java", "T"): "y/T.java", ("a.java", "z.*"): "z/Z.java"}
    now = G.store_dependencies(e, e.filter("id = 6").withColumns({"id": F.lit(7).cast("long"), "codebase": F.lit("r")}), "r", "repo_dependency")
    assert {r["id"] for r in now.collect()} == {1, 2, 3, 4, 6, 7}
    assert [tuple(r) for r in G.repo_dependencies(now).collect()] == [("r", 1), ("s", 1)]
    symbols = spark.createDataFrame([("r", "T", "b.java", 9, 10, "class"), ("r", "T", "a.java", 1, 2, "class"), ("s", "T", "c.java", 1, 2, "class")], "codebase string, name string, file_path string, start_line int, end_line int, kind string")
    assert [[x["file_path"] for x in r["entries"]] for r in G.symbol_table(symbols, "r").collect()] == [["a.java", "b.java"]]


def test_rounds_find_the_clusters(spark):
    e = clusters(spark)
    one, many = (G.communities(e, most=m).collect() for m in (10**6, 0))
    groups = lambda rows: {frozenset(r["file_path"] for r in rows if r["community_id"] == c) for c in {r["community_id"] for r in rows}}
    assert groups(one) == groups(many) and abs(one[0]["modularity"] - many[0]["modularity"]) < 1e-4


def test_paths_from_many_starts(spark):
    """All files of a name are starts, however many."""
    rows = [(f"s{i}.java", f"t{i}.java", "calls", None) for i in range(45)] + [("s3.java", "shared.java", "calls", None), ("s1.java", "shared.java", "calls", None)]
    symbols = spark.createDataFrame([("repo", f"s{i}.java", "Same") for i in range(45)], "codebase string, file_path string, name string")
    got = {r["file"]: r["path"] for r in G.graph_traverse(edges(spark, rows), symbols, "Same", include_paths=True, max_results=200).collect()}
    assert got == {f"t{i}.java": [f"s{i}.java", f"t{i}.java"] for i in range(45)} | {"shared.java": ["s1.java", "shared.java"]}


def test_nearest_folder_and_similar_names_equal_all_pairs(spark):
    import difflib
    import random

    rng = random.Random(5)
    folder = lambda: "/".join(rng.choice("abc") for _ in range(rng.randint(0, 3)))
    place = lambda f, n: f"{f}/{n}" if f else n
    defs = sorted({("run", place(folder(), f"d{i}.java")) for i in range(25)} | {("".join(rng.choice("abcdeRST") for _ in range(rng.randint(1, 9))), f"z/n{i}.java") for i in range(60)})
    calls = [(i, place(folder(), "x.java"), "run", "") for i in range(25)] + [(100 + i, "q/q/x.java", "".join(rng.choice("abcdeRST") for _ in range(rng.randint(1, 9))), "") for i in range(60)]
    got = {r["call_id"]: r for r in G.resolve_calls(spark.createDataFrame(calls, "call_id long, source_file string, callee string, receiver string"), spark.createDataFrame([], "source_file string, name string, target_file string"), spark.createDataFrame(defs, "short string, file_path string")).collect()}
    split = lambda p: p.split("/")[:-1]

    def away(p, q):
        x, y = split(p), split(q)
        same = next((i for i, (m, n) in enumerate(zip(x, y)) if m != n), min(len(x), len(y)))
        return len(x) + len(y) - 2 * same

    files = {}
    for name, path in defs:
        files.setdefault(name, []).append(path)
    for i, source, name, _ in calls:
        r = got[i]
        if name == "run" and r["strategy"] == "nearest":
            assert r["target_file"] == min(files["run"], key=lambda p: (away(source, p), p))
        elif name not in files:
            ratio = {n: difflib.SequenceMatcher(None, name.lower(), n.lower()).ratio() for n in files}
            top = max(ratio.values())
            assert (r["strategy"] == "fuzzy") == (top >= 0.7), (name, top)
            if top >= 0.7:
                assert abs(r["confidence"] - (0.30 + (top - 0.7) / 3)) < 1e-9
