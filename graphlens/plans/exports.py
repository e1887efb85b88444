"""Texts for other tools: package graphs, bills of materials, rules, reports.

Texts of many lines are rows (part, key, line): in the order of part and key they are the text, and the caller writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _line(df: DataFrame, part: int, key: Column, line: Column) -> DataFrame:
    return df.select(F.lit(part).alias("part"), key.alias("key"), line.alias("line"))


def _fixed(df: DataFrame, part: int, line: str) -> DataFrame:
    return _line(df.sparkSession.range(1), part, F.lit(""), F.lit(line))


def _nodes(package_edges: DataFrame, cyclic: DataFrame) -> DataFrame:
    nodes = package_edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(cyclic.select("id", F.lit(True).alias("red")).distinct(), "id", "left")


def dot(package_edges: DataFrame, cyclic: DataFrame) -> DataFrame:
    """Package edges (src, dst, n) as lines of DOT; packages on a cycle (id) are red."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    nodes = _line(_nodes(package_edges, cyclic), 1, F.col("id"), F.concat(F.lit("  "), quote("id"), F.when(F.col("red"), " [color=red]").otherwise(""), F.lit(";")))
    links = _line(package_edges, 2, F.concat_ws("\n", "src", "dst"), F.concat(F.lit("  "), quote("src"), F.lit(" -> "), quote("dst"), F.lit(" [label="), F.col("n").cast("string"), F.lit("];")))
    return _fixed(package_edges, 0, "digraph packages {").unionByName(nodes).unionByName(links).unionByName(_fixed(package_edges, 3, "}")).orderBy("part", "key")


def mermaid(package_edges: DataFrame, cyclic: DataFrame) -> DataFrame:
    """The same graph as lines of Mermaid."""
    name = lambda c: F.translate(F.col(c), ".-", "__")
    nodes = _nodes(package_edges, cyclic)
    shown = _line(nodes, 1, F.col("id"), F.concat(F.lit("  "), name("id"), F.lit("["), F.substring_index("id", ".", -2), F.lit("]")))
    links = _line(package_edges, 2, F.concat_ws("\n", "src", "dst"), F.concat(F.lit("  "), name("src"), F.lit(" -->|"), F.col("n").cast("string"), F.lit("| "), name("dst")))
    red = _line(nodes.filter("red"), 3, F.col("id"), F.concat(F.lit("  style "), name("id"), F.lit(" fill:#f66")))
    return _fixed(package_edges, 0, "graph LR").unionByName(shown).unionByName(links).unionByName(red).orderBy("part", "key")


def cyclonedx(components: DataFrame) -> DataFrame:
    """One CycloneDX document (project_id, document) for each project's components."""
    item = F.struct(F.lit("library").alias("type"), F.nullif("group_id", F.lit("")).alias("group"), F.col("artifact_id").alias("name"), "version", "purl", "scope")
    rows = components.groupBy("project_id").agg(F.sort_array(F.collect_list(item)).alias("components"))
    return rows.select("project_id", F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), "components")).alias("document"))


def semgrep_rules(rules: DataFrame) -> DataFrame:
    """Rules (rule_id, severity, message, language, pattern) as YAML, a text a rule."""
    quote = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.char_length(F.to_json(F.array(c))) - 2)
    text = F.concat(F.lit("rules:\n  - id: "), "rule_id", F.lit("\n    severity: "), "severity", F.lit("\n    languages: ["), "language", F.lit("]\n    message: "), quote(F.col("message")), F.lit("\n    pattern-regex: "), quote(F.col("pattern")), F.lit("\n"))
    return rules.select("rule_id", text.alias("yaml"))


VERDICTS = ("TRUE_RISK", "NEEDS_REVIEW", "LIKELY_FALSE_POSITIVE")


def markdown(reports: DataFrame) -> DataFrame:
    """Verdicts (verdict, confidence, finding_id, rule_id, file_path, line) as lines of Markdown: counts, then findings by verdict."""
    counts = reports.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    rows = F.array(*[F.struct(F.lit(i).cast("string").alias("k"), F.concat(F.lit(f"- {v}: "), F.col(v).cast("string")).alias("l")) for i, v in enumerate(VERDICTS)])
    head = _fixed(reports, 0, "# Findings\n").unionByName(counts.select(F.explode(rows).alias("r")).select(F.lit(1).alias("part"), F.col("r.k").alias("key"), F.col("r.l").alias("line")))
    text = F.format_string("\n## %s %s (%.2f)\n\n%s at `%s:%d`", "finding_id", "verdict", "confidence", "rule_id", "file_path", "line")
    key = F.concat_ws("\n", "verdict", F.format_string("%.6f", 1 - F.col("confidence")), "finding_id")
    return head.unionByName(_line(reports, 2, key, text)).orderBy("part", "key")


def source_sink_rules(rules: DataFrame) -> DataFrame:
    """Rules (rule_id, sources, sinks: arrays) as JSON, a document a rule."""
    return rules.select("rule_id", F.to_json(F.struct(F.col("rule_id").alias("id"), F.sort_array("sources").alias("sources"), F.sort_array("sinks").alias("sinks"))).alias("document"))


def cached_pages(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages (package, page, facts_hash) with the text that a cache (facts_hash, text) has for equal facts, else their own, and whether it had one."""
    known = cache.groupBy("facts_hash").agg(F.max("text").alias("text"))
    return pages.join(known, "facts_hash", "left").select("package", F.coalesce("text", "page").alias("page"), "facts_hash", F.col("text").isNotNull().alias("cached"))


def package_pages(facts: DataFrame) -> DataFrame:
    """A page (package, page, facts_hash) for each row of package facts; equal facts have equal hashes."""
    body = F.concat(
        F.lit("# "), "package", F.lit("\n\n- units: "), F.col("units").cast("string"), F.lit("\n- entry points: "), F.col("entry_points").cast("string"), F.lit("\n- used by: "), F.col("inbound").cast("string"),
        F.lit("\n- uses: "), F.col("outbound").cast("string"), F.lit("\n- key symbols: "), "key_symbols", F.lit("\n"),
    )
    return facts.select("package", body.alias("page"), F.sha2(body, 256).alias("facts_hash"))
