"""Units and relations from texts: sections of documents, heuristic signatures, Python by its own parser, Java by tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.plans.lineage import cut
from graphlens.sources.read import read

UNIT = (
    "id string, project_id string, file_path string, language string, kind string, qualified_name string, simple_name string, start_line int, end_line int, raw_source string, "
    "signature string, annotations string, parent_qualified_name string, is_entry_point boolean, is_test boolean, degraded boolean"
)
RELATION = "source_id string, target_ref string, kind string, file_path string, source_line int, seq long"


def sections(files: DataFrame) -> DataFrame:
    """Sections of Markdown files (file_path, content) at headings of one to three signs: qualified_name, heading, start_line, end_line, text.

    What comes before the first heading is named after the file; a name that is there already gets its line; blank
    sections are dropped.
    """
    lines = files.select("file_path", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    head = F.col("line").rlike(r"^#{1,3} .+")
    order = Window.partitionBy("file_path").orderBy("i")
    numbered = lines.withColumn("s", F.sum(head.cast("int")).over(order))
    grouped = numbered.groupBy("file_path", "s").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.sort_array(F.collect_list(F.struct("i", "line"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    title = F.when(F.col("s") == 0, F.element_at(F.split("file_path", "/"), -1)).otherwise(F.trim(F.regexp_replace(F.col("rows")[0]["line"], r"^#{1,3} ", "")))
    named = grouped.select("file_path", "s", (F.col("a") + 1).alias("start_line"), (F.col("b") + 1).alias("end_line"), title.alias("heading"), text.alias("text")).filter("trim(text) <> ''")
    again = F.row_number().over(Window.partitionBy("file_path", "heading").orderBy("start_line")) > 1
    name = F.concat("file_path", F.lit("#"), "heading", F.when(again, F.concat(F.lit("-L"), F.col("start_line").cast("string"))).otherwise(""))
    return named.select("file_path", name.alias("qualified_name"), "heading", "start_line", "end_line", "text")


#: Patterns of signatures by language, and whether a body is in braces.
SIGNATURES = {
    "java": [(r"^\s*(?:public|protected|private|static|final|abstract|\s)*(?:class|interface|enum|record)\s+(\w+)", "CLASS"), (r"^\s*(?:public|protected|private|static|final|synchronized|\s)*[\w<>\[\], ?]+\s+(\w+)\s*\([^;]*$", "METHOD")],
    "c": [(r"^(?:static\s+|inline\s+|extern\s+)*[A-Za-z_][\w\s\*]*\b(\w+)\s*\([^;]*$", "FUNCTION")],
    "cpp": [(r"^\s*class\s+(\w+)", "CLASS"), (r"^[A-Za-z_][\w\s\*&:<>]*\b(\w+)\s*\([^;]*$", "FUNCTION")],
    "javascript": [(r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)", "FUNCTION"), (r"^\s*(?:export\s+)?class\s+(\w+)", "CLASS")],
    "typescript": [(r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)", "FUNCTION"), (r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", "CLASS"), (r"^\s*(?:export\s+)?interface\s+(\w+)", "INTERFACE")],
    "python": [(r"^\s*class\s+(\w+)", "CLASS"), (r"^\s*(?:async\s+)?def\s+(\w+)", "METHOD")],
}
_NOT_NAMES = frozenset(("if", "for", "while", "switch", "catch", "return", "else", "do", "new", "throw"))


def unit_id(project: str, path: str, kind: str, name: str) -> str:
    import hashlib

    return hashlib.sha256(f"{project}{path}{kind}{name}".encode()).hexdigest()


def heuristic(files: DataFrame) -> DataFrame:
    """Units of files (file_path, language, content, perhaps project_id) by the shape of their signatures; bodies end with their braces or indent."""

    def units(project: str, path: str, lang: str, content: str) -> list[tuple]:
        import re

        lines, out = (content or "").split("\n"), []
        for pattern, kind in SIGNATURES.get(lang, []):
            want = re.compile(pattern)
            for i, line in enumerate(lines):
                m = want.match(line)
                if not m or m[1] in _NOT_NAMES:
                    continue
                end = _indented(lines, i) if lang == "python" else _braced(lines, i)
                if end is not None:
                    name = f"{path}#{m[1]}@L{i + 1}"
                    out.append((unit_id(project, path, kind, name), project, path, lang, kind, name, m[1], i + 1, end + 1, "\n".join(lines[i : end + 1]), line.strip().rstrip("{").strip(), "", None, False, False, True))
        return out

    return _parsed(files, units, UNIT)


def _indented(lines: list[str], at: int) -> int:
    depth = len(lines[at]) - len(lines[at].lstrip())
    end = at
    for j in range(at + 1, len(lines)):
        if lines[j].strip():
            if len(lines[j]) - len(lines[j].lstrip()) <= depth:
                break
            end = j
    return end


def _braced(lines: list[str], at: int) -> int | None:
    depth, opened = 0, False
    for j in range(at, len(lines)):
        for c in lines[j]:
            depth += (c == "{") - (c == "}")
            opened |= c == "{"
        if opened and depth <= 0:
            return j
        if not opened and ";" in lines[j]:
            return None
    return None


def python_file(project: str, path: str, content: str) -> tuple[list[tuple], list[tuple]]:
    """Units and relations of a Python file: what stands at its top and in the bodies of its classes.

    Methods are named by their class, functions by themselves.  A call is known if it names a function or method that
    came before it (or itself), or a method of ``self`` or ``cls`` wherever that stands; other calls of plain names keep an
    id that no unit has, and calls on other objects give nothing.  A file that the parser refuses gives nothing.
    """
    import ast

    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    lines, units, relations = (content or "").split("\n"), [], []
    classes: dict[str, str] = {}
    callables: dict[str, str] = {}
    functions = ast.FunctionDef | ast.AsyncFunctionDef
    test_file = (name := path.rsplit("/", 1)[-1]).startswith("test_") or name.endswith("_test.py")

    def relate(source: str, target: str, kind: str, line: int) -> None:
        relations.append((source, target, kind, path, line, len(relations)))

    def add(node, kind: str, name: str, signature: str, marks: list[str], parent: str | None, test: bool) -> str:
        own = unit_id(project, path, kind, name)
        text = "\n".join(lines[node.lineno - 1 : node.end_lineno])
        units.append((own, project, path, "python", kind, name, node.name, node.lineno, node.end_lineno, text.strip(), signature, ",".join(marks), parent, False, test, False))
        return own

    def shown(args: ast.arguments) -> str:
        parts = [(a, "") for a in (*args.posonlyargs, *args.args)]
        parts += [(args.vararg, "*")] if args.vararg else []
        parts += [(a, "") for a in args.kwonlyargs] + ([(args.kwarg, "**")] if args.kwarg else [])
        names = [ast.unparse(a.annotation) if a.annotation else star + a.arg for a, star in parts]
        return ",".join(n for n in names if n not in ("self", "cls"))

    def calls(node):
        """Calls in the order of the text's tree, without those of definitions inside."""
        if isinstance(node, ast.Call):
            yield node
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, functions | ast.ClassDef):
                yield from calls(child)

    def function(node, owner: str | None, owner_id: str | None) -> None:
        name, types = f"{owner}#{node.name}" if owner else node.name, shown(node.args)
        marks = ["@" + ast.unparse(d).split("(")[0] for d in node.decorator_list]
        test = node.name.startswith(("test_", "Test")) or any("test" in m or "Test" in m for m in marks) or test_file
        head = "async def " if isinstance(node, ast.AsyncFunctionDef) else "def "
        own = add(node, "METHOD", name, f"{head}{node.name}({types})" + (f" -> {ast.unparse(node.returns)}" if node.returns else ""), marks, owner, test)
        callables[name] = own
        if owner_id:
            relate(owner_id, own, "CONTAINS", node.lineno)
        for call in (c for s in node.body if not isinstance(s, functions | ast.ClassDef) for c in calls(s)):
            f = call.func
            if isinstance(f, ast.Name):
                relate(own, callables.get(f.id) or callables.get(f"{owner}#{f.id}") or unit_id("", "", "METHOD", f.id), "CALLS", call.lineno)
            elif isinstance(f, ast.Attribute) and owner and isinstance(f.value, ast.Name) and f.value.id in ("self", "cls"):
                relate(own, unit_id(project, path, "METHOD", f"{owner}#{f.attr}"), "CALLS", call.lineno)

    def walk(body: list, owner: str | None, owner_id: str | None) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                name = f"{owner}.{node.name}" if owner else node.name
                own = add(node, "CLASS", name, f"class {node.name}", [], owner, False)
                classes[name] = classes[node.name] = own
                for base in (ast.unparse(b) for b in node.bases if isinstance(b, ast.Name | ast.Attribute)):
                    relate(own, classes.get(base, base), "EXTENDS", node.lineno)
                walk(node.body, name, own)
            elif isinstance(node, functions):
                function(node, owner, owner_id)
            elif isinstance(node, ast.Import):
                for a in node.names:
                    relate(path, a.name, "IMPORTS", node.lineno)
            elif isinstance(node, ast.ImportFrom) and node.module:
                relate(path, node.module, "IMPORTS", node.lineno)

    walk(tree.body, None, None)
    return units, relations


def java_file(project: str, path: str, content: str, units_only: bool = False) -> tuple[list[tuple], list[tuple]]:
    """Units and relations of a Java file; of the latter the imports alone with ``units_only``."""
    from graphlens.sources.java import Reader

    lines = (content or "").split("\n")
    reader = Reader(content or "", path, lambda kind, name: unit_id(project, path, kind, name))
    reader.read(units_only)
    units = [
        (unit_id(project, path, u.kind, u.name), project, path, "java", u.kind, u.name, u.simple, u.start, u.end, "\n".join(lines[u.start - 1 : u.end]), u.signature, ",".join(u.marks), u.parent, u.entry, u.test, False)
        for u in reader.units
    ]
    found = [(r.source, r.target, r.kind, path, r.line) for r in reader.relations] + [(path, name, "IMPORTS", path, line) for name, line in reader.imported]
    return units, [(*r, n) for n, r in enumerate(found)]


def script_file(language: str):
    """The reader of a JavaScript or TypeScript file."""

    def read(project: str, path: str, content: str) -> tuple[list[tuple], list[tuple]]:
        from graphlens.sources.scripts import Script

        found = Script(content or "")
        ids = [unit_id(project, path, u[0], u[1]) for u in found.units]
        units = [(i, project, path, language, kind, name, simple, a, b, text, signature, "", parent, entry, False, False) for i, (kind, name, simple, a, b, text, signature, parent, entry) in zip(ids, found.units)]
        target = lambda to: ids[to] if isinstance(to, int) else unit_id("", "", "FUNCTION", to)
        return units, [(ids[u], target(to), "CALLS", path, line, n) for n, (u, to, line) in enumerate(found.calls)]

    return read


def c_file(project: str, path: str, content: str) -> tuple[list[tuple], list[tuple]]:
    """Units and relations of a C file."""
    from graphlens.sources.scripts import CSource

    found = CSource(content or "")
    ids = [unit_id(project, path, u[0], u[9]) for u in found.units]
    units = [(i, project, path, "c", kind, name, simple, a, b, text, signature, "", parent, entry, False, False) for i, (kind, name, simple, a, b, text, signature, parent, entry, _) in zip(ids, found.units)]
    target = lambda to: ids[to] if isinstance(to, int) else unit_id("", "", "FUNCTION", to)
    raw = [(ids[u], target(to), "CALLS", path, line) for u, to, line in found.calls] + [(ids[u], ids[f], "CONTAINS", path, line) for u, f, line in found.contains] + [(path, header, "IMPORTS", path, line) for header, line in found.includes]
    return units, [(*r, n) for n, r in enumerate(raw)]


PARSERS = {"python": python_file, "java": java_file, "javascript": script_file("javascript"), "typescript": script_file("typescript"), "c": c_file}


def precise_units(files: DataFrame) -> DataFrame:
    """Units of Python, Java, JavaScript, TypeScript and C files (file_path, language, content, perhaps project_id)."""
    parsers = {**PARSERS, "java": lambda project, path, content: java_file(project, path, content, True)}

    def made(project: str, path: str, lang: str, content: str) -> list[tuple]:
        return parsers[lang](project, path, content)[0]

    return _parsed(files.filter(F.col("language").isin(*PARSERS)), made, UNIT)


def python_units(files: DataFrame) -> DataFrame:
    """Classes, methods and functions of Python files by the standard library's parser; files it refuses give nothing."""
    return precise_units(files.filter("language = 'python'"))


def _raw(files: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Units, with these columns alone, and raw relations of files: each file is read once, and what it gives is written
    to the shared folder, since all that follows takes it several times."""
    parsers, own = PARSERS, [(i, f) for i, f in enumerate(UNIT.split(", ")) if f.split()[0] in columns]
    links = [f"_{f}" for f in RELATION.split(", ")]
    places, no_unit, no_link = [i for i, _ in own], (None,) * len(own), (None,) * len(links)

    def made(project: str, path: str, lang: str, content: str) -> list[tuple]:
        units, found = parsers[lang](project, path, content)
        return [(*[u[i] for i in places], *no_link) for u in units if places] + [(*no_unit, *r) for r in found]

    both = cut(_parsed(files.filter(F.col("language").isin(*PARSERS)), made, ", ".join([f for _, f in own] + links)))
    names = [f.split()[0] for _, f in own]
    return both.filter("_source_id IS NULL").select(*names), both.filter("_source_id IS NOT NULL").select(*[F.col(n).alias(n[1:]) for n in both.columns if n.startswith("_")])


def relations(files: DataFrame) -> DataFrame:
    """Raw relations (source_id, target_ref, kind, file_path, source_line, seq) of files that ``precise_units`` reads, for ``resolve_edges``.

    An import leads from its file to the file of the project that it names, else to the name as it stands; a header that is
    neither at the project's root nor beside its file gives nothing.
    """
    return _with_places(_raw(files)[1], files)


def units_and_relations(files: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """``precise_units``, with these columns alone, and ``relations`` of files that are read once."""
    units, raw = _raw(files, *columns)
    return units, _with_places(raw, files)


def _with_places(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Raw relations whose imports and headers lead to files.

    A name is looked up once, however many files import it.  Tables of a row a file meet by exchange: the optimiser would
    judge them by the bytes of the table that the paths are made from, and send them to the driver.
    """
    apart = lambda df: df.hint("merge")
    headers = raw.filter("kind = 'IMPORTS' AND file_path RLIKE '[.][ch]$'")
    imports = raw.filter("kind = 'IMPORTS' AND NOT file_path RLIKE '[.][ch]$'").withColumn("python", F.col("file_path").endswith(".py"))
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    places = files.select(F.col("file_path").alias("to"), last(F.col("file_path")).alias("name"), last(F.regexp_replace("file_path", "/[^/]*$", "")).alias("folder"))
    wanted = imports.select("target_ref", "python").distinct().withColumn("as_path", F.replace("target_ref", F.lit("."), F.lit("/")))
    java = wanted.filter("NOT python").withColumn("name", F.concat(last(F.col("as_path")), F.lit(".java"))).join(apart(places), "name").filter(F.col("to").endswith(F.concat("as_path", F.lit(".java"))))
    module = wanted.filter("python").withColumn("name", F.concat(last(F.col("as_path")), F.lit(".py"))).join(apart(places), "name").filter(F.col("to") == F.concat("as_path", F.lit(".py")))
    package = wanted.filter("python").withColumn("folder", last(F.col("as_path"))).join(apart(places.filter("name = '__init__.py'")), "folder").filter(F.col("to") == F.concat("as_path", F.lit("/__init__.py")))
    found = java.select("target_ref", "python", "to").unionByName(module.select("target_ref", "python", "to")).unionByName(package.select("target_ref", "python", "to"))
    best = found.groupBy("target_ref", "python").agg(F.min_by("to", F.struct(F.col("to").endswith("__init__.py"), "to")).alias("to"))
    known = imports.join(apart(best), ["target_ref", "python"], "left").withColumn("target_ref", F.coalesce("to", "target_ref")).select(*raw.columns)
    beside = F.concat(F.regexp_replace("file_path", "[^/]*$", ""), F.col("target_ref"))
    there = files.select(F.col("file_path").alias("to")).distinct()
    both = headers.select("*", F.posexplode(F.array("target_ref", beside)).alias("rank", "to")).join(apart(there), "to")
    first = both.groupBy(*raw.columns).agg(F.min_by("to", "rank").alias("to")).withColumn("target_ref", F.col("to")).select(*raw.columns)
    return raw.filter("kind <> 'IMPORTS'").unionByName(known).unionByName(first)


def _parsed(files: DataFrame, rows, schema: str) -> DataFrame:
    project = "project_id" if "project_id" in files.columns else F.lit("")
    own = files.select(F.coalesce(project, F.lit("")).alias("project_id"), "file_path", "language", "content")
    return read(own, "content", ["project_id", "file_path"], rows, schema)


def dispatched(files: DataFrame, mode: str = "AUTO") -> DataFrame:
    """Units file by file: precise ones (mode PRECISE), heuristic ones (HEURISTIC), or (AUTO) precise ones where there are any, else heuristic ones, marked as degraded."""
    if mode not in ("PRECISE", "HEURISTIC", "AUTO"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "HEURISTIC":
        return heuristic(files)
    precise = precise_units(files)
    if mode == "PRECISE":
        return precise
    return precise.unionByName(heuristic(files).join(precise.select("file_path").distinct(), "file_path", "left_anti").select(*precise.columns))
