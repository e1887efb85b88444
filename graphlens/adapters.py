"""The driver's tables as inputs of the engine: code units, relations, findings, events.

Each adapter is one SQL text that Spark and DuckDB both accept, so a query and its check start from the same rows.
Spark fills the table names with DataFrames, DuckDB has them as views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Where a part's class stands: classes are nations, packages are regions.
PLACES = "nation JOIN region ON n_regionkey = r_regionkey"
CLASS_NAME = "'com.' || lower(replace(r_name, ' ', '')) || '.' || replace(n_name, ' ', '')"
CLASS_FILE = "'src/' || lower(replace(r_name, ' ', '')) || '/' || replace(n_name, ' ', '') || '.java'"
#: The parameter list in the name of a method.
PARAMETERS = "CASE WHEN p_partkey % 3 = 0 THEN '()' WHEN p_partkey % 3 = 1 THEN '(String)' ELSE '(String,int)' END"

#: Methods are parts, classes are nations, packages are regions; flags and sources follow the part's number.
UNITS = f"""
SELECT 'c' || CAST(n_nationkey AS STRING) AS id, 'p1' AS project_id, 'CLASS' AS kind, 'java' AS language, {CLASS_NAME} AS qualified_name, replace(n_name, ' ', '') AS simple_name,
  {CLASS_FILE} AS file_path, 1 AS start_line, 9 AS end_line,
  'class ' || replace(n_name, ' ', '') || ' {{ }}' AS raw_source, 'class ' || replace(n_name, ' ', '') AS signature,
  CASE WHEN n_nationkey % 4 = 0 THEN '@RestController,@RequestMapping' WHEN n_nationkey % 4 = 1 THEN '@Service' WHEN n_nationkey % 4 = 2 THEN '@Mapper' ELSE '' END AS annotations,
  CAST(NULL AS STRING) AS parent_qualified_name, false AS is_entry_point, false AS is_test, CAST(NULL AS BIGINT) AS num
FROM {PLACES}
UNION ALL
SELECT 'm' || CAST(p_partkey AS STRING), CASE WHEN p_partkey % 25 = 24 THEN 'p2' ELSE 'p1' END,
  CASE WHEN p_partkey % 13 = 0 THEN 'CONSTRUCTOR' WHEN p_partkey % 17 = 0 THEN 'FUNCTION' ELSE 'METHOD' END, CASE WHEN p_partkey % 5 = 0 THEN 'python' ELSE 'java' END,
  {CLASS_NAME} || '#run' || CAST(p_partkey AS STRING) || {PARAMETERS}, 'run' || CAST(p_partkey AS STRING), {CLASS_FILE}, CAST(10 * p_partkey + 10 AS INT), CAST(10 * p_partkey + 18 AS INT),
  'void run' || CAST(p_partkey AS STRING) || '() {{ ' || repeat('if (a) {{ b(); }} ', CAST(p_partkey % 7 AS INT)) || repeat('for (x) {{ y(); }} ', CAST(p_partkey % 4 AS INT)) || repeat('}} else if (c && d) {{ ', CAST(p_partkey % 3 AS INT))
    || CASE WHEN p_partkey % 9 = 0 THEN 'st.executeQuery("select " + name); ' ELSE '' END || CASE WHEN p_partkey % 10 = 3 THEN 'Runtime.getRuntime().exec(cmd); ' ELSE '' END
    || CASE WHEN p_partkey % 11 = 2 THEN 'String password = "x1"; ' ELSE '' END || CASE WHEN p_partkey % 8 = 5 THEN 'MessageDigest.getInstance("MD5"); ' ELSE '' END
    || CASE WHEN p_partkey % 12 = 7 THEN 'log.info("token " + token);' ELSE '' END || CASE WHEN p_partkey % 14 = 1 THEN 'in = new ObjectInputStream(x).readObject(); ' ELSE '' END || '}}',
  'void run' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '()' WHEN p_partkey % 3 = 1 THEN '(String a)' ELSE '(String a, int b)' END,
  CASE WHEN p_partkey % 6 = 0 THEN '@PreAuthorize,@RequestParam' WHEN p_partkey % 6 = 3 THEN '@GetMapping' ELSE '' END,
  {CLASS_NAME}, p_partkey % 11 = 0, p_partkey % 7 = 0, p_partkey
FROM part JOIN (SELECT * FROM {PLACES}) places ON p_partkey % 25 = n_nationkey
"""

#: Every line item is a relation of a part to the part of this number; line items tell its kind by their number.
TARGET = "(l_suppkey * 7 + l_partkey % 50) % (SELECT count(*) FROM part)"
KIND = """CASE l_linenumber WHEN 1 THEN 'CALLS' WHEN 2 THEN 'DEFINES_TYPE' WHEN 3 THEN 'OVERRIDES' WHEN 4 THEN 'EXTENDS' WHEN 5 THEN 'IMPLEMENTS' ELSE 'IMPORTS' END"""

#: Raw relations: a target is named by id, by qualified name, by name and arity, or not at all.
RAW_EDGES = f"""
SELECT 'm' || CAST(l_partkey AS STRING) AS source_id,
  CASE WHEN l_orderkey % 4 = 0 THEN 'm' || CAST(p_partkey AS STRING) WHEN l_orderkey % 4 = 1 THEN base || {PARAMETERS}
    WHEN l_orderkey % 4 = 2 THEN base || '::arity=' || CAST(p_partkey % 3 AS STRING) ELSE 'lib.Missing#run()' END AS target_ref,
  {KIND} AS kind, 'f' || CAST(l_orderkey % 50 AS STRING) || '.java' AS file_path, l_linenumber AS source_line, l_orderkey AS seq
FROM (SELECT *, {TARGET} AS target FROM lineitem) l JOIN (
  SELECT p_partkey, {CLASS_NAME} || '#run' || CAST(p_partkey AS STRING) AS base
  FROM part JOIN (SELECT * FROM {PLACES}) places ON p_partkey % 25 = n_nationkey) t ON p_partkey = target
"""

#: Resolved relations between units, with containment of methods in classes.
EDGES = f"""
SELECT DISTINCT 'm' || CAST(l_partkey AS STRING) AS src, 'm' || CAST({TARGET} AS STRING) AS dst, {KIND} AS kind FROM lineitem
UNION ALL
SELECT 'c' || CAST(p_partkey % 25 AS STRING), 'm' || CAST(p_partkey AS STRING), 'CONTAINS' FROM part
"""

#: Findings of the engine itself, from events.
FINDINGS = """
SELECT 'f' || CAST(event_id AS STRING) AS id, CASE WHEN user_id % 5 = 0 THEN 'p2' ELSE 'p1' END AS project_id,
  CASE event_type WHEN 'error' THEN 'SQL_INJECTION' WHEN 'click' THEN 'WEAK_CRYPTO' WHEN 'purchase' THEN 'PATH_TRAVERSAL' WHEN 'signup' THEN 'COMMAND_INJECTION' ELSE 'SENSITIVE_LOG' END AS rule_id,
  CASE event_type WHEN 'error' THEN 'CWE-89' WHEN 'click' THEN 'CWE-327' WHEN 'purchase' THEN 'CWE-22' WHEN 'signup' THEN 'CWE-78' ELSE 'CWE-200' END AS cwe,
  CASE WHEN event_id % 9 = 0 THEN 'CRITICAL' WHEN event_id % 3 = 0 THEN 'HIGH' WHEN event_id % 3 = 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN event_id % 4 = 0 THEN 'CONFIRMED' WHEN event_id % 4 = 1 THEN 'FIXED' WHEN event_id % 4 = 2 THEN 'DISMISSED' ELSE 'SUSPECTED' END AS status,
  'm' || CAST(event_id % (SELECT count(*) FROM part) AS STRING) AS unit_id, 'fp' || CAST(event_id % 997 AS STRING) AS fingerprint, ts AS found_at, event_id
FROM events
"""

#: Components with versions from parts, and advisories with ranges.
COMPONENTS = """
SELECT p_partkey, 'g' || CAST(p_partkey % 20 AS STRING) AS group_id, 'a' || CAST(p_partkey % 50 AS STRING) AS artifact_id,
  CAST(p_size % 5 AS STRING) || '.' || CAST(p_partkey % 12 AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '.' || CAST(p_partkey % 7 AS STRING) ELSE '' END || CASE WHEN p_partkey % 10 = 0 THEN '-SNAPSHOT' ELSE '' END AS version,
  CASE WHEN p_partkey % 6 = 0 THEN 'excluded' WHEN p_partkey % 6 = 1 THEN 'optional' ELSE 'required' END AS scope
FROM part
"""
ADVISORIES = """
SELECT 'ADV-' || CAST(n_nationkey AS STRING) AS advisory_id, 'g' || CAST(n_nationkey % 20 AS STRING) AS group_id, 'a' || CAST(n_nationkey * 3 % 50 AS STRING) AS artifact_id,
  CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE CAST(n_nationkey % 3 AS STRING) || '.2' END AS introduced, CASE WHEN n_nationkey % 7 = 0 THEN '' ELSE '3.' || CAST(n_nationkey AS STRING) END AS fixed
FROM nation
"""

ADAPTERS = {"units": UNITS, "raw_edges": RAW_EDGES, "edges": EDGES, "findings": FINDINGS, "components": COMPONENTS, "advisories": ADVISORIES}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table, or an adapter over them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = ADAPTERS[name]
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)]
    text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in used})


def duck(select: str, **ctes: str) -> str:
    """DuckDB SQL: ``select`` over the named parts and the adapters that they mention."""
    parts = {k: v for k, v in ctes.items()}
    used = [n for n in ADAPTERS if any(re.search(rf"\b{n}\b", t) for t in (select, *parts.values()))]
    once = lambda k, v: "" if re.search(rf"\b(?:FROM|JOIN) {k}\b", v) else "MATERIALIZED "
    head = [f"{n} AS MATERIALIZED ({ADAPTERS[n]})" for n in used] + [f"{k} AS {once(k, v)}({v})" for k, v in parts.items()]
    return f"WITH RECURSIVE {', '.join(head)} {select}" if head else select
