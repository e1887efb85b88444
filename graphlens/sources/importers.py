"""Findings of external scanners, from their JSON reports (name, content), as rows of one schema.

Columns: tool, rule_id, cwe, severity, message, file_path, start_line, end_line, symbol, trace, fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.code import cwe, severity, short_hash

STEP = "struct<file_path: string, start_line: int, end_line: int, kind: string, symbol: string, message: string>"


def _step(path: Column, start: Column, end: Column, kind: Column, message: Column) -> Column:
    return F.struct(path.alias("file_path"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), kind.alias("kind"), F.lit("").alias("symbol"), F.coalesce(message, F.lit("")).alias("message"))


def _findings(rows: DataFrame) -> DataFrame:
    """Valid rows only: a rule, a file and a positive line; an end before the start is the start."""
    own = rows.filter("trim(rule_id) <> '' AND trim(file_path) <> '' AND start_line > 0").withColumn("end_line", F.when(F.col("end_line") >= F.col("start_line"), F.col("end_line")).otherwise(F.col("start_line")))
    return own.withColumn("fingerprint", short_hash(F.col("tool"), F.col("rule_id"), F.col("file_path"), F.col("start_line").cast("string"), between="|"))


def semgrep(reports: DataFrame) -> DataFrame:
    schema = """results array<struct<check_id: string, path: string, start: struct<line: int>, end: struct<line: int>, extra: struct<severity: string, message: string,
      metadata: struct<cwe: string, cwe_id: string, tags: array<string>, function: string>,
      dataflow_trace: struct<source: struct<path: string, line: int>, intermediate_vars: array<struct<path: string, line: int>>, sink: struct<path: string, line: int>>>>>"""
    r = reports.select(F.explode(F.from_json("content", schema)["results"]).alias("r"))
    meta, flow = F.col("r.extra.metadata"), F.col("r.extra.dataflow_trace")
    one = lambda s, kind: _step(s["path"], s["line"], s["line"], F.lit(kind), F.lit(""))
    trace = F.when(flow.isNull(), F.array().cast(f"array<{STEP}>")).otherwise(F.filter(F.concat(F.array(one(flow["source"], "source")), F.transform(F.coalesce(flow["intermediate_vars"], F.array()), lambda s: one(s, "call")), F.array(one(flow["sink"], "sink"))), lambda s: s["file_path"].isNotNull()))
    rows = r.select(
        F.lit("semgrep").alias("tool"), F.col("r.check_id").alias("rule_id"), F.coalesce(cwe(meta["cwe"]), cwe(meta["cwe_id"]), cwe(F.array_join(meta["tags"], " "))).alias("cwe"), severity(F.col("r.extra.severity")).alias("severity"),
        F.col("r.extra.message").alias("message"), F.col("r.path").alias("file_path"), F.col("r.start.line").alias("start_line"), F.col("r.end.line").alias("end_line"), F.coalesce(meta["function"], F.lit("")).alias("symbol"), trace.alias("trace"),
    )
    return _findings(rows)


def sarif(reports: DataFrame, max_findings: int | None = None) -> DataFrame:
    """SARIF reports; rule tags give the CWE wherever the tool's description stands in the run.

    All findings of a report are given; ``max_findings`` keeps the first so many of each report, in its order.
    """
    place = "struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, endLine: int>>"
    schema = f"""runs array<struct<tool: struct<driver: struct<name: string, rules: array<struct<id: string, properties: struct<tags: array<string>>>>>>,
      results: array<struct<ruleId: string, level: string, message: struct<text: string>, locations: array<struct<physicalLocation: {place}>>,
      codeFlows: array<struct<threadFlows: array<struct<locations: array<struct<location: struct<physicalLocation: {place}, message: struct<text: string>>>>>>>>>>>>"""
    runs = reports.select("name", F.posexplode(F.from_json("content", schema)["runs"]).alias("run", "r"))
    rules = runs.select("name", "run", F.explode("r.tool.driver.rules").alias("rule")).select("name", "run", F.col("rule.id").alias("rule_id"), cwe(F.array_join("rule.properties.tags", " ")).alias("cwe"))
    rows = runs.select("name", "run", F.col("r.tool.driver.name").alias("driver"), F.posexplode("r.results").alias("i", "x"))
    at, steps = F.get(F.col("x.locations"), F.lit(0))["physicalLocation"], F.flatten(F.transform(F.flatten(F.transform(F.coalesce("x.codeFlows", F.array()), lambda c: c["threadFlows"])), lambda t: t["locations"]))
    trace = F.transform(steps, lambda s, i: _step(s["location"]["physicalLocation"]["artifactLocation"]["uri"], s["location"]["physicalLocation"]["region"]["startLine"], F.coalesce(s["location"]["physicalLocation"]["region"]["endLine"], s["location"]["physicalLocation"]["region"]["startLine"]), F.when(i == 0, "source").when(i == F.size(steps) - 1, "sink").otherwise("call"), s["location"]["message"]["text"]))
    out = rows.select(
        "name", "run", "i", F.lower(F.coalesce("driver", F.lit("sarif"))).alias("tool"), F.col("x.ruleId").alias("rule_id"), severity(F.coalesce("x.level", F.lit("warning"))).alias("severity"), F.col("x.message.text").alias("message"),
        at["artifactLocation"]["uri"].alias("file_path"), at["region"]["startLine"].alias("start_line"), F.coalesce(at["region"]["endLine"], at["region"]["startLine"]).alias("end_line"), F.lit("").alias("symbol"), trace.alias("trace"),
    )
    best = rules.groupBy("name", "run", "rule_id").agg(F.first("cwe", ignorenulls=True).alias("cwe"))
    kept = out
    if max_findings is not None:
        kept = out.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("run", "i"))).filter(F.col("n") <= max_findings).drop("n")
    return _findings(kept.join(best, ["name", "run", "rule_id"], "left").drop("name", "run", "i"))


def slither(reports: DataFrame) -> DataFrame:
    schema = "results struct<detectors: array<struct<check: string, impact: string, description: string, elements: array<struct<name: string, source_mapping: struct<filename_relative: string, lines: array<int>>>>>>>"
    d = reports.select(F.explode(F.from_json("content", schema)["results"]["detectors"]).alias("d")).withColumn("e", F.get(F.col("d.elements"), F.lit(0)))
    lines = F.filter(F.col("e.source_mapping.lines"), lambda x: x > 0)
    rows = d.select(
        F.lit("slither").alias("tool"), F.col("d.check").alias("rule_id"), cwe(F.col("d.description")).alias("cwe"), severity(F.col("d.impact")).alias("severity"), F.col("d.description").alias("message"),
        F.col("e.source_mapping.filename_relative").alias("file_path"), F.array_min(lines).alias("start_line"), F.array_max(lines).alias("end_line"), F.coalesce("e.name", F.lit("")).alias("symbol"), F.array().cast(f"array<{STEP}>").alias("trace"),
    )
    return _findings(rows)
