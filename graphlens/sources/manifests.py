"""Components from build manifests (project_id, file_path, content): ecosystem, group_id, artifact_id, version, scope, purl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("project_id", "ecosystem", "group_id", "artifact_id", "version", "scope", "purl")


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.element_at(F.split("file_path", "/"), -1) == name)


def maven(files: DataFrame) -> DataFrame:
    """Direct dependencies of pom.xml, without managed ones; scope test is excluded, provided and system are optional."""
    plain = F.regexp_replace(F.regexp_replace("content", r"(?s)<!--.*?-->", ""), r"(?s)<dependencyManagement>.*?</dependencyManagement>", "")
    deps = _named(files, "pom.xml").select("project_id", F.explode(F.regexp_extract_all(plain, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("d"))
    get = lambda tag: F.trim(F.regexp_extract(F.regexp_replace("d", r"(?s)<exclusions>.*?</exclusions>", ""), rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    rows = deps.select("project_id", get("groupId").alias("group_id"), get("artifactId").alias("artifact_id"), get("version").alias("version"), get("scope").alias("s")).filter("group_id <> '' AND artifact_id <> ''")
    scope = F.when(F.col("s") == "test", "excluded").when(F.col("s").isin("provided", "system"), "optional").otherwise("required")
    purl = F.concat(F.lit("pkg:maven/"), "group_id", F.lit("/"), "artifact_id", F.when(F.col("version") != "", F.concat(F.lit("@"), "version")).otherwise(""))
    return rows.select("project_id", F.lit("maven").alias("ecosystem"), "group_id", "artifact_id", "version", scope.alias("scope"), purl.alias("purl"))


def _gradle_scope(configuration: Column) -> Column:
    low = F.lower(configuration)
    return F.when(low.contains("test"), "excluded").when(low.startswith("compileonly"), "optional").otherwise("required")


def gradle(files: DataFrame) -> DataFrame:
    """Components of build scripts: literal coordinates and entries of the version catalog, which win over literal ones."""
    toml = _named(files, "libs.versions.toml").select("project_id", F.explode(F.split("content", "\n")).alias("line")).select("project_id", F.trim("line").alias("line"))
    versions = toml.filter(F.col("line").rlike(r'^[\w.-]+\s*=\s*"[^"]*"\s*$')).select("project_id", F.regexp_extract("line", r"^([\w.-]+)", 1).alias("ref"), F.regexp_extract("line", r'"([^"]*)"', 1).alias("version"))
    module = F.coalesce(F.nullif(F.regexp_extract("line", r'module\s*=\s*"([^"]+)"', 1), F.lit("")), F.concat(F.regexp_extract("line", r'group\s*=\s*"([^"]+)"', 1), F.lit(":"), F.regexp_extract("line", r'name\s*=\s*"([^"]+)"', 1)))
    libs = toml.filter(F.col("line").rlike(r"^[\w.-]+\s*=\s*\{")).select("project_id", F.regexp_replace(F.regexp_extract("line", r"^([\w.-]+)", 1), "[-_]", ".").alias("alias"), module.alias("module"), F.regexp_extract("line", r'version\.ref\s*=\s*"([^"]+)"', 1).alias("ref"), F.regexp_extract("line", r'version\s*=\s*"([^"]+)"', 1).alias("own"))
    catalog = libs.join(versions, ["project_id", "ref"], "left").select("project_id", "alias", F.split_part("module", F.lit(":"), F.lit(1)).alias("group_id"), F.split_part("module", F.lit(":"), F.lit(2)).alias("artifact_id"), F.coalesce(F.nullif("own", F.lit("")), "version", F.lit("")).alias("version"))
    scripts = files.filter(F.col("file_path").rlike(r"\.gradle(\.kts)?$")).select("project_id", F.explode(F.split("content", "\n")).alias("line"))
    used = scripts.select("project_id", F.regexp_extract("line", r"^\s*(\w+)\s*\(?\s*libs\.([\w.]+)", 1).alias("conf"), F.regexp_extract("line", r"^\s*(\w+)\s*\(?\s*libs\.([\w.]+)", 2).alias("alias")).filter("conf <> ''")
    named = used.join(catalog, ["project_id", "alias"]).select("project_id", "group_id", "artifact_id", "version", _gradle_scope(F.col("conf")).alias("scope"))
    literal = r"^\s*(\w+)\s*\(?\s*[\"']([^:\"']+):([^:\"']+)(?::([^:\"'@]+))?[\"'@]"
    inline = scripts.select("project_id", *[F.regexp_extract("line", literal, i).alias(c) for i, c in enumerate(("conf", "group_id", "artifact_id", "version"), 1)]).filter("conf <> ''")
    inline = inline.select("project_id", "group_id", "artifact_id", "version", _gradle_scope(F.col("conf")).alias("scope"))
    both = named.unionByName(inline.join(named, ["project_id", "group_id", "artifact_id"], "left_anti")).distinct()
    purl = F.concat(F.lit("pkg:maven/"), "group_id", F.lit("/"), "artifact_id", F.when(F.col("version") != "", F.concat(F.lit("@"), "version")).otherwise(""))
    return both.select("project_id", F.lit("gradle").alias("ecosystem"), "group_id", "artifact_id", "version", "scope", purl.alias("purl"))


def npm(files: DataFrame) -> DataFrame:
    """The four sections of package.json."""
    sections = {"dependencies": "required", "devDependencies": "excluded", "peerDependencies": "optional", "optionalDependencies": "optional"}
    kind = "struct<" + ", ".join(f"{s}: map<string, string>" for s in sections) + ">"
    own = _named(files, "package.json").withColumn("j", F.from_json("content", kind))
    out = None
    for s, scope in sections.items():
        rows = own.select("project_id", F.explode(F.col("j")[s]).alias("artifact_id", "version")).withColumn("scope", F.lit(scope))
        out = rows if out is None else out.unionByName(rows)
    version = F.regexp_replace("version", r"^[~^>=<]+\s*", "")
    purl = F.concat(F.lit("pkg:npm/"), F.replace("artifact_id", F.lit("@"), F.lit("%40")), F.lit("@"), version)
    return out.select("project_id", F.lit("npm").alias("ecosystem"), F.lit("").alias("group_id"), "artifact_id", version.alias("version"), "scope", purl.alias("purl"))


def pip(files: DataFrame) -> DataFrame:
    """requirements*.txt and the dependencies of pyproject.toml."""
    lines = files.filter(F.element_at(F.split("file_path", "/"), -1).rlike(r"^requirements.*\.txt$")).select("project_id", F.explode(F.split("content", "\n")).alias("line"))
    block = F.regexp_extract("content", r"(?s)\bdependencies\s*=\s*\[(.*?)\]", 1)
    project = _named(files, "pyproject.toml").select("project_id", F.explode(F.regexp_extract_all(block, F.lit(r"[\"']([^\"']+)[\"']"), F.lit(1))).alias("line"))
    rows = lines.unionByName(project).select("project_id", F.trim(F.substring_index("line", "#", 1)).alias("line")).filter("line <> '' AND NOT startswith(line, '-')")
    name, version = F.regexp_extract("line", r"^([A-Za-z0-9._-]+)", 1), F.regexp_extract("line", r"[=!<>~^]+\s*([^,;\s]+)", 1)
    parts = rows.select("project_id", name.alias("artifact_id"), version.alias("version")).filter("artifact_id <> ''").dropDuplicates(["project_id", "artifact_id", "version"])
    purl = F.concat(F.lit("pkg:pypi/"), F.replace(F.lower("artifact_id"), F.lit("_"), F.lit("-")), F.when(F.col("version") != "", F.concat(F.lit("@"), "version")).otherwise(""))
    return parts.select("project_id", F.lit("pip").alias("ecosystem"), F.lit("").alias("group_id"), "artifact_id", "version", F.lit("required").alias("scope"), purl.alias("purl"))


def components(files: DataFrame) -> DataFrame:
    """Components of the first build system that a project has: Maven, Gradle, npm, pip."""
    tagged = None
    for rank, kind in enumerate((maven, gradle, npm, pip)):
        rows = kind(files).select(*COLUMNS, F.lit(rank).alias("rank"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    first = tagged.groupBy("project_id").agg(F.min("rank").alias("rank"))
    return tagged.join(first, ["project_id", "rank"], "left_semi").select(*COLUMNS)
