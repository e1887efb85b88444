"""Files of a project: scanning, languages, classes of files, archives, churn."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never scanned.
EXCLUDED = ("build", "target", "out", ".gradle", ".git", ".idea", "node_modules", "__pycache__", ".tox", ".venv", "venv", ".mvn", ".cache")
#: Extensions by language.
LANGUAGES = {
    "java": ("java",), "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"), "python": ("py",), "javascript": ("js", "jsx", "mjs", "cjs"),
    "typescript": ("ts", "tsx", "mts", "cts"), "class": ("class",), "doc": ("md", "markdown"),
}
#: Folders and extensions that tell what a file is for.
GENERATED = ("target", "build", "out", "dist", "node_modules", "vendor", "__pycache__", "generated", "generated-sources", ".git", ".gradle", ".idea", ".vscode")
DOCUMENTS = ("md", "markdown", "rst", "adoc", "asciidoc", "txt")
CODE = ("java", "kt", "kts", "c", "h", "cc", "cpp", "cxx", "hpp", "py", "js", "jsx", "ts", "tsx", "go", "rs", "php", "rb", "swift", "cs", "sol", "scala", "groovy")
#: Languages of an asset's files by extension; a file named dockerfile is one.
FILE_LANGUAGES = {
    "java": ("java",), "kotlin": ("kt", "kts"), "c": ("c", "h"), "cpp": ("cc", "cpp", "cxx", "hpp"), "python": ("py",), "javascript": ("js", "jsx"), "typescript": ("ts", "tsx"),
    "go": ("go",), "rust": ("rs",), "php": ("php",), "ruby": ("rb",), "swift": ("swift",), "csharp": ("cs",), "solidity": ("sol",), "scala": ("scala",), "groovy": ("groovy",),
    "yaml": ("yml", "yaml"), "xml": ("xml",), "json": ("json",), "toml": ("toml",), "properties": ("properties",),
}
#: Languages that scanners take.
GRAPH_LANGUAGES = ("java", "c", "python")
BROAD_LANGUAGES = ("java", "kotlin", "c", "cpp", "python", "javascript", "typescript", "go", "php", "ruby", "solidity")
BUILDLESS_LANGUAGES = ("java", "kotlin", "python", "javascript", "typescript", "csharp", "ruby")
CONFIG = ("xml", "yml", "yaml", "properties", "toml", "json", "gradle", "lock")


def _name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def extension(path: Column) -> Column:
    return F.regexp_extract(_name(path), r"\.([^.]+)$", 1)


def language(path: Column) -> Column:
    """Language by extension, null if unknown."""
    pairs = [F.lit(x) for lang, exts in LANGUAGES.items() for e in exts for x in (e, lang)]
    return F.element_at(F.create_map(*pairs), extension(path))


def file_language(path: Column) -> Column:
    """Language of an asset's file, null if unknown: more of them than are parsed (``language``)."""
    pairs = [F.lit(x) for lang, exts in FILE_LANGUAGES.items() for e in exts for x in (e, lang)]
    return F.coalesce(F.element_at(F.create_map(*pairs), extension(path)), F.when(_name(path) == "dockerfile", "dockerfile"))


def included(path: Column, languages: list[str] | None = None) -> Column:
    """Whether a relative path is scanned: no excluded folder, and a wanted language (by default all but documents and bytecode)."""
    wanted = languages or [x for x in LANGUAGES if x not in ("doc", "class")]
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED))) & F.coalesce(language(path).isin(*wanted), F.lit(False))


def scan(spark: SparkSession, root: str, languages: list[str] | None = None) -> DataFrame:
    """(file_path, hash, content) of the files of a project that are scanned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + _quoted(root.rstrip("/")) + "/", "")
    return files.select(path.alias("file_path"), F.md5("content").alias("hash"), F.decode("content", "UTF-8").alias("content")).filter(included(F.col("file_path"), languages))


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def classified(path: Column) -> Column:
    """GENERATED, TEST, DOCUMENTATION, BUSINESS or UNKNOWN, the first that fits."""
    low, name, ext = F.lower(path), _name(path), extension(path)
    within = lambda folders: F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, folders)))
    test = within(("test", "tests", "__tests__", "spec")) | name.rlike(r"^.*(test|tests|spec)\.[^.]+$")
    doc = within(("docs", "doc")) | ext.isin(*DOCUMENTS) | name.rlike("^(readme|license|changelog)")
    known = name.isin("pom.xml", "dockerfile", "makefile", "package.json", "pyproject.toml") | name.rlike(r"^(requirements|application\.|\.env)")
    return F.when(within(GENERATED), "GENERATED").when(test, "TEST").when(doc, "DOCUMENTATION").when(ext.isin(*CODE, *CONFIG) | known, "BUSINESS").otherwise("UNKNOWN")


def distributions(files: DataFrame) -> DataFrame:
    """(bucket, key, n) of classes and languages of files (file_path)."""
    rows = files.select(F.explode(F.array(F.struct(F.lit("category").alias("bucket"), classified(F.col("file_path")).alias("key")), F.struct(F.lit("language").alias("bucket"), file_language(F.col("file_path")).alias("key")))).alias("x")).select("x.*")
    return rows.filter("key IS NOT NULL").groupBy("bucket", "key").agg(F.count("*").alias("n"))


def scanner_plan(facts: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(project_id, scanner, selected, source) for each scanner, from languages and build systems (arrays).

    The source is AUTO, or the override that decided; an exclusion wins, and a name that is no scanner's is an error.
    """
    any_of = lambda c, *v: F.arrays_overlap(F.col(c), F.array(*map(F.lit, v)))
    applies = {
        "GRAPH_CODE": any_of("languages", *GRAPH_LANGUAGES), "GRAPH_TAINT": any_of("languages", "java"), "PRECISE_TAINT": any_of("languages", "java") & any_of("builds", "maven", "gradle"),
        "SEMGREP": any_of("languages", *BROAD_LANGUAGES), "CODEQL": any_of("languages", *BUILDLESS_LANGUAGES), "SLITHER": any_of("languages", "solidity"), "DEPENDENCY_CVE": F.size("builds") > 0,
    }
    if unknown := {*(include or []), *(exclude or [])} - set(applies):
        raise ValueError(f"unknown scanners: {', '.join(sorted(unknown))}")
    chosen = {s: (F.lit(False), "EXCLUDE_OVERRIDE") if s in (exclude or []) else (F.lit(True), "INCLUDE_OVERRIDE") if s in (include or []) else (c, "AUTO") for s, c in applies.items()}
    rows = F.array(*[F.struct(F.lit(s).alias("scanner"), c.alias("selected"), F.lit(by).alias("source")) for s, (c, by) in chosen.items()])
    return facts.select("project_id", F.explode(rows).alias("x")).select("project_id", "x.*")


def churn(log: DataFrame) -> DataFrame:
    """(file_path, changes) from lines of a change log (value): names of files, blank lines between commits."""
    name = F.replace(F.trim("value"), F.lit("\\"), F.lit("/"))
    return log.select(name.alias("file_path")).filter("file_path <> ''").groupBy("file_path").agg(F.count("*").alias("changes"))


def archive_entries(names: DataFrame, max_entries: int = 20_000, max_depth: int = 40) -> DataFrame:
    """Entries (archive, name, is_link) with the reason why they are refused (null if they are not), before anything is unpacked."""
    path = F.replace("name", F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    twice = F.count("*").over(_by("archive", "clean")) > 1
    rows = names.withColumn("clean", F.array_join(parts, "/"))
    reasons = [
        (F.col("is_link"), "link"), (path.startswith("/") | path.rlike("^[A-Za-z]:"), "absolute"), (F.array_contains(parts, ".."), "traversal"), (twice, "duplicate"),
        (F.size(parts) > max_depth, "depth"), (F.count("*").over(_by("archive")) > max_entries, "entries"),
    ]
    return rows.withColumn("refused", reduce(lambda a, r: F.when(r[0], r[1]).otherwise(a), reversed(reasons), F.lit(None).cast("string")))


def _by(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)
