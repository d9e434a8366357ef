"""Source files to relations: imports, symbols, hierarchy, call sites, build dependencies. A file is a row; parsers run in Arrow batches.

Python uses the standard syntax tree; the other languages a line front end, as no grammar library is at hand."""

from __future__ import annotations

import ast
import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.operators.segment import JAVA_WORDS, KOTLIN_WORDS, each_file, language_of

IMPORT = "name string, edge_type string, line int"
SYMBOL = "name string, kind string, start_line int, end_line int"
PARENT = "child string, parent string, edge_type string, line int"
CALL = "callee string, receiver string, line int"
DEPENDENCY = "group_id string, artifact string, version string, scope string, is_internal boolean, module_path string, coordinate string"


def _tree(source: str) -> ast.Module | None:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError):
        return None


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def without_comments(source: str) -> str:
    """Comments of the C family become spaces; line feeds stay, so line numbers do."""
    return re.sub(r"/\*.*?\*/|//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)


def _lines(source: str) -> Iterator[tuple[int, str]]:
    yield from enumerate(without_comments(source).split("\n"), 1)


def bare_type(text: str) -> str:
    """Without type arguments, constructor arguments and annotations."""
    while (cut := re.sub(r"<[^<>]*>", "", text)) != text:
        text = cut
    return re.sub(r"\(.*", "", re.sub(r"@\w+\s*", "", text)).strip()


# ---- imports ------------------------------------------------------------------------------------


def imports_of(source: str, path: str) -> Iterator[tuple]:
    language = language_of(path)
    if language == "python":
        for node in ast.walk(_tree(source) or ast.Module([], [])):
            if isinstance(node, ast.Import):
                yield from ((a.name, "import", node.lineno) for a in node.names)
            elif isinstance(node, ast.ImportFrom):
                base = "." * node.level + (node.module or "")
                for a in node.names:
                    yield (base, "wildcard_import", node.lineno) if a.name == "*" else (f"{base}.{a.name}" if node.module else base + a.name, "import", node.lineno)
    elif language in ("java", "kotlin"):
        for no, line in _lines(source):
            if m := re.match(r"\s*import\s+(static\s+)?([\w.]+?)(\.\*)?(?:\s+as\s+\w+)?\s*;?\s*$", line):
                yield m[2], "static_import" if m[1] else "wildcard_import" if m[3] else "import", no
    elif language == "typescript":
        text = without_comments(source)
        at = lambda m: text.count("\n", 0, m.start()) + 1
        for m in re.finditer(r"""(?m)^\s*import\s+(?:type\s+)?(?:([^'";]*?)\s+from\s+)?['"]([^'"]+)['"]""", text):
            what = (m[1] or "").strip()
            yield m[2], "side_effect" if not what else "namespace_import" if what.startswith("*") else "import" if what.startswith("{") else "default_import", at(m)
        for m in re.finditer(r"""(?m)^\s*export\s+(?:type\s+)?(?:\*(?:\s+as\s+\w+)?|\{[^}]*\})\s+from\s+['"]([^'"]+)['"]""", text):
            yield m[1], "reexport", at(m)
        for m in re.finditer(r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)""", text):
            yield m[1], "require", at(m)


# ---- symbols and hierarchy ----------------------------------------------------------------------

HEADS = {
    "java": re.compile(rf"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:{JAVA_WORDS}\s+)*(class|interface|enum|record)\s+(\w+)([^{{]*)"),
    "kotlin": re.compile(rf"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:{KOTLIN_WORDS}\s+)*(enum\s+class|class|interface|object)\s+(\w+)([^{{]*)"),
    "typescript": re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(class|interface|enum|type)\s+(\w+)([^{]*)"),
}
FUNCTIONS = {
    "java": re.compile(rf"^\s+(?:@\w+\s+)*(?:{JAVA_WORDS}\s+)+(?:<[^>]+>\s+)?[\w<>\[\], .?]+\s+(\w+)\s*\([^;]*$"),
    "kotlin": re.compile(rf"^\s*(?:{KOTLIN_WORDS}\s+)*fun\s+(?:<[^>]+>\s+)?(?:[\w<>.?]+\.)?(\w+)\s*[(<]"),
    "typescript": re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(\w+)|^\s*(?:export\s+)?const\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"),
}


def closing_line(lines: list[str], start: int) -> int:
    """The line (from 1) where the braces that open at or after a line close; the line itself without any."""
    depth, opened = 0, False
    for i in range(start - 1, len(lines)):
        depth += lines[i].count("{") - lines[i].count("}")
        opened |= "{" in lines[i]
        if opened and depth <= 0:
            return i + 1
        if not opened and lines[i].rstrip().endswith((";", ")")) and i > start:
            break
    return start if not opened else len(lines)


def symbols_of(source: str, path: str) -> Iterator[tuple]:
    language = language_of(path)
    if language == "python":
        tree = _tree(source)

        def walk(node: ast.AST, inside: str) -> Iterator[tuple]:
            for x in ast.iter_child_nodes(node):
                if isinstance(x, ast.ClassDef):
                    yield inside + x.name, "class", x.lineno, x.end_lineno
                    yield from walk(x, f"{inside}{x.name}.")
                elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    yield inside + x.name, "method" if inside else "function", x.lineno, x.end_lineno

        yield from walk(tree, "") if tree else ()
        return
    if language not in HEADS:
        return
    lines = without_comments(source).split("\n")
    open_: list[tuple[str, int]] = []
    for no, line in enumerate(lines, 1):
        open_ = [o for o in open_ if o[1] >= no]
        prefix = f"{open_[-1][0]}." if open_ else ""
        if m := HEADS[language].match(line):
            kind = {"enum class": "enum", "type": "type_alias", "record": "class"}.get(re.sub(r"\s+", " ", m[1]), m[1])
            end = closing_line(lines, no)
            yield prefix + m[2], kind, no, end
            if end > no:
                open_.append((prefix + m[2], end))
        elif m := FUNCTIONS[language].match(line):
            name = next(g for g in m.groups() if g)
            yield prefix + name, "method" if open_ else "function", no, closing_line(lines, no)


def hierarchy_of(source: str, path: str) -> Iterator[tuple]:
    language = language_of(path)
    if language == "python":
        for node in ast.walk(_tree(source) or ast.Module([], [])):
            if isinstance(node, ast.ClassDef):
                for base in node.bases:
                    name = _dotted(base.value if isinstance(base, ast.Subscript) else base)
                    if name and name != "object":
                        yield node.name, name, "extends", node.lineno
        return
    if language not in HEADS:
        return
    text = without_comments(source)
    split = lambda s: [bare_type(x) for x in re.split(r",(?![^<(]*[>)])", s) if bare_type(x)]
    for m in re.finditer(HEADS[language].pattern, text, re.M):
        child, rest, no = m[2], m[3], text.count("\n", 0, m.start(2)) + 1
        if language == "kotlin":
            tail = re.search(r":\s*(.*)$", re.sub(r"\([^()]*\)(?=\s*:)", "", rest, count=1), re.S)
            for raw in re.split(r",(?![^<(]*[>)])", tail[1]) if tail else ():
                if by := re.match(r"\s*([\w.<>, ]+?)\s+by\s+", raw):
                    yield child, bare_type(by[1]), "delegation", no
                elif bare_type(raw):
                    yield child, bare_type(raw), "extends" if "(" in raw else "implements", no
            continue
        for word in ("extends", "implements"):
            if found := re.search(rf"\b{word}\s+(.*?)(?=\bimplements\b|\bextends\b|\bpermits\b|$)", rest, re.S):
                yield from ((child, p, word, no) for p in split(found[1]))


# ---- calls --------------------------------------------------------------------------------------

NO_CALLS = {"if", "for", "while", "switch", "catch", "return", "new", "super", "this", "when", "synchronized", "fun", "throw", "else", "try", "do", "assert"}


def calls_of(source: str, path: str) -> Iterator[tuple]:
    language = language_of(path)
    if language == "python":
        for node in ast.walk(_tree(source) or ast.Module([], [])):
            if isinstance(node, ast.Call) and (name := _dotted(node.func)):
                receiver, _, callee = name.rpartition(".")
                yield callee, receiver, node.lineno
    elif language in ("java", "kotlin"):
        for no, line in _lines(source):
            if HEADS[language].match(line) or FUNCTIONS[language].match(line) or re.match(r"\s*(?:import|package)\b", line):
                continue
            for m in re.finditer(r"(?:\b([A-Za-z_][\w.]*)\.)?\b([A-Za-z_]\w*)\s*\(", re.sub(r'"(?:\\.|[^"\\])*"', '""', line)):
                if m[2] not in NO_CALLS:
                    yield m[2], m[1] or "", no


def enclosed_calls_of(source: str, path: str) -> Iterator[tuple]:
    """Each call with its innermost symbol: the smallest span that holds the line, then the first, then the least name."""
    found = sorted(((end - start, start, name, end) for name, _, start, end in symbols_of(source, path)), reverse=True)
    owner: list[str | None] = [None] * (source.count("\n") + 2)
    for span, start, name, end in found:
        owner[start : end + 1] = [name] * (span + 1)
    for callee, receiver, line in calls_of(source, path):
        yield callee, receiver, line, owner[line]


# ---- build files --------------------------------------------------------------------------------

# Words that declare a dependency.
SCOPES = ("testRuntimeOnly", "testImplementation", "runtimeOnly", "compileOnly", "annotationProcessor", "kapt", "api", "implementation")
SCOPE = r"\b(" + "|".join(SCOPES) + r")"
REQUIREMENT = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(.*)$")


def _coordinate(scope: str, text: str) -> tuple:
    g, a, v = (text.split(":") + ["", ""])[:3]
    return g, a, v, scope, False, None, text


def _module(scope: str, path: str) -> tuple:
    return "", path, "", scope, True, path, f"project:{path}"


def gradle(source: str) -> Iterator[tuple]:
    """Both dialects: projects first, then strings, then maps; catalog references last, as `libs.x.y`."""
    text = without_comments(re.sub(r"(?<=:)//", "\0\0", source)).replace("\0", "/")
    for m in re.finditer(SCOPE + r"""\s*\(?\s*project\s*\(\s*(?:path\s*[:=]\s*)?['"]([^'"]+)['"]""", text):
        yield _module(m[1], m[2])
    for m in re.finditer(SCOPE + r"""\s*(?:\(\s*)?(['"])([^'"]+:[^'"]+)\2""", text):
        yield _coordinate(m[1], m[3])
    for m in re.finditer(SCOPE + r"""\s+group:\s*'([^']+)'\s*,\s*name:\s*'([^']+)'\s*(?:,\s*version:\s*'([^']*)')?""", text):
        yield m[2], m[3], m[4] or "", m[1], False, None, ":".join(x for x in (m[2], m[3], m[4]) if x)
    for m in re.finditer(SCOPE + r"\s*\(\s*libs\.([A-Za-z0-9_.]+)\s*\)", text):
        yield "", "", "", m[1], False, None, f"libs.{m[2]}"


def settings(source: str) -> Iterator[tuple]:
    for block in re.findall(r"include\s*\(([^)]+)\)|include\s+([^\n]+)", source):
        for m in re.findall(r"""['"]([^'"]+)['"]""", block[0] or block[1]):
            yield _module("include", m)


def catalog(source: str) -> Iterator[tuple]:
    """A version catalog: the alias, dashes and underscores as points, is the coordinate; group, artifact and version beside it."""
    try:
        data = tomllib.loads(source)
    except tomllib.TOMLDecodeError:
        return
    versions = data.get("versions", {})
    for alias, entry in data.get("libraries", {}).items():
        name = re.sub(r"[-_]", ".", alias)
        if isinstance(entry, str):
            g, a, v = (entry.split(":") + ["", ""])[:3]
        else:
            g, a = (entry["module"].split(":") + [""])[:2] if "module" in entry else (entry.get("group", ""), entry.get("name", ""))
            v = entry.get("version", "")
            v = versions.get(v.get("ref"), "") if isinstance(v, dict) else v
        yield g, a, v if isinstance(v, str) else "", "catalog", False, None, f"libs.{name}"


def maven(source: str) -> Iterator[tuple]:
    try:
        root = ET.fromstring(source)
    except ET.ParseError:
        return
    space = re.match(r"\{.*\}", root.tag)
    ns = space[0] if space else ""
    values = {f"${{{k.tag.removeprefix(ns)}}}": (k.text or "").strip() for p in root.findall(f"{ns}properties") for k in p}
    for name in ("groupId", "version", "artifactId"):
        own = root.findtext(f"{ns}{name}") or root.findtext(f"{ns}parent/{ns}{name}") or ""
        values[f"${{project.{name}}}"] = own.strip()
    fill = lambda t: re.sub(r"\$\{[^}]+\}", lambda m: values.get(m[0], m[0]), (t or "").strip())
    for d in root.findall(f"{ns}dependencies/{ns}dependency"):
        g, a, v = (fill(d.findtext(f"{ns}{k}")) for k in ("groupId", "artifactId", "version"))
        yield g, a, v, fill(d.findtext(f"{ns}scope")) or "compile", False, None, ":".join(x for x in (g, a, v) if x)


def _required(line: str, scope: str) -> Iterator[tuple]:
    line = line.split("#")[0].split(";")[0].strip()
    if line and not line.startswith("-") and (m := REQUIREMENT.match(line)):
        version = re.sub(r"^[=<>!~^ ]+", "", m[2]).strip()
        yield "", m[1], version, scope, False, None, m[1] if not version else f"{m[1]}:{version}"


def pyproject(source: str) -> Iterator[tuple]:
    try:
        data = tomllib.loads(source)
    except tomllib.TOMLDecodeError:
        return
    project = data.get("project", {})
    for line in project.get("dependencies", []):
        yield from _required(line, "runtime")
    for scope, lines in project.get("optional-dependencies", {}).items():
        for line in lines:
            yield from _required(line, scope)
    for name, v in data.get("tool", {}).get("poetry", {}).get("dependencies", {}).items():
        if name != "python":
            version = re.sub(r"^[=<>!~^ ]+", "", v if isinstance(v, str) else v.get("version", ""))
            yield "", name, version, "runtime", False, None, f"{name}:{version}" if version else name


def package_json(source: str) -> Iterator[tuple]:
    try:
        data = json.loads(source)
    except ValueError:
        return
    for section, scope in (("dependencies", "runtime"), ("devDependencies", "dev"), ("peerDependencies", "peer"), ("optionalDependencies", "optional")):
        for name, v in (data.get(section) or {}).items():
            group, _, artifact = name.rpartition("/")
            inner = str(v).startswith(("workspace:", "file:", "link:"))
            yield group, artifact, str(v), scope, inner, str(v).split(":", 1)[1] if inner else None, f"{name}:{v}"


def builds_of(source: str, path: str) -> Iterator[tuple]:
    name = path.rsplit("/", 1)[-1]
    if name.startswith("settings.gradle"):
        yield from settings(source)
    elif name.endswith((".gradle", ".gradle.kts")):
        yield from gradle(source)
    elif name.endswith(".versions.toml"):
        yield from catalog(source)
    elif name == "pom.xml":
        yield from maven(source)
    elif name == "pyproject.toml":
        yield from pyproject(source)
    elif re.fullmatch(r"requirements.*\.txt", name):
        yield from (r for line in source.split("\n") for r in _required(line, "runtime"))
    elif name == "package.json":
        yield from package_json(source)


def imports(rows: DataFrame, **columns: str) -> DataFrame:
    return each_file(rows, imports_of, IMPORT, **columns)


def symbols(rows: DataFrame, **columns: str) -> DataFrame:
    return each_file(rows, symbols_of, SYMBOL, **columns)


def hierarchy(rows: DataFrame, **columns: str) -> DataFrame:
    return each_file(rows, hierarchy_of, PARENT, **columns)


def call_sites(rows: DataFrame, **columns: str) -> DataFrame:
    return each_file(rows, calls_of, CALL, **columns)


def enclosed_calls(rows: DataFrame, **columns: str) -> DataFrame:
    """Calls with their innermost symbol, found where the file is parsed: no join."""
    return each_file(rows, enclosed_calls_of, CALL + ", symbol string", **columns)


def dependencies(rows: DataFrame, **columns: str) -> DataFrame:
    """All build formats; references to a version catalog are resolved by an equi-join on the alias."""
    found = each_file(rows, builds_of, DEPENDENCY, **columns)
    known = found.filter("scope = 'catalog'").groupBy("coordinate").agg(F.min_by(F.struct("group_id", "artifact", "version"), "file_path").alias("c"))
    used = found.filter("scope <> 'catalog'").join(known, "coordinate", "left")
    pick = lambda k: F.coalesce(F.nullif(F.col(k), F.lit("")), F.col(f"c.{k}"), F.lit("")).alias(k)
    whole = F.when(F.col("c").isNotNull(), F.concat_ws(":", "c.group_id", "c.artifact", F.nullif(F.col("c.version"), F.lit("")))).otherwise(F.col("coordinate"))
    return used.select("file_path", pick("group_id"), pick("artifact"), pick("version"), "scope", "is_internal", "module_path", whole.alias("coordinate"))


def dependency_edges(found: DataFrame, codebase: str, edge_type: str = "build_dependency") -> DataFrame:
    """External dependencies as edges without a target; `repo_dependency` edges point at their coordinate."""
    target = F.col("coordinate") if edge_type == "repo_dependency" else F.lit(None).cast("string")
    return found.filter(~F.col("is_internal")).select(F.lit(codebase).alias("codebase"), F.col("file_path").alias("source_file"), target.alias("target_file"), F.lit(edge_type).alias("edge_type"), F.col("coordinate").alias("metadata")).distinct()


def symbol_rows(found: DataFrame, codebase: str) -> DataFrame:
    """With an id that holds path, name and line, so overloads stay apart."""
    return found.select(F.concat_ws(":", F.lit(codebase), "file_path", F.lit(""), "name", "start_line").alias("id"), F.lit(codebase).alias("codebase"), "file_path", "name", "kind", "start_line", "end_line", F.regexp_extract("name", r"([^.]+)$", 1).alias("short"))


def labelled(nodes: DataFrame, chunks: DataFrame, cache: DataFrame, label, hash_col: str = "hash") -> DataFrame:
    """nodes (id, file_path, start_line) joined to the covering chunk; labels come from the cache by content hash, the rest from the
    pluggable `label` expression over (name, content)."""
    w = Window.partitionBy("id").orderBy(F.col("c_end") - F.col("c_start"), "c_start")
    cover = nodes.join(chunks.select("file_path", F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"), "content", F.col(hash_col).alias("hash")), "file_path").filter(F.col("start_line").between(F.col("c_start"), F.col("c_end")))
    one = cover.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    got = one.join(cache.select("hash", F.col("label").alias("known")), "hash", "left")
    return got.select("id", "file_path", "name", "hash", F.col("known").isNotNull().alias("cached"), F.coalesce("known", label(F.col("name"), F.col("content"))).alias("label"))
