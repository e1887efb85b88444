"""Advisories and rules from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ADVISORY = "id string, groupId string, artifactId string, introduced string, fixed string, severity string, summary string"
CONFIG_RULE = "id string, severity string, type string, key string, valuePattern string, negate boolean"
THREAT_RULE = "id string, severity string, pattern string, group int, minCount int, whitelistChecked boolean, timePattern string, detail string"


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements of the JSON arrays in the files at ``path``; properties that the schema lacks are ignored."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def advisories(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(advisory_id, group_id, artifact_id, introduced, fixed, severity, summary): the table that is known, or where it is empty the seed at ``path``, one row an id and artifact."""
    if known is not None and known.limit(1).count():
        return known
    rows = _documents(spark, path, ADVISORY).filter("id IS NOT NULL AND groupId IS NOT NULL AND artifactId IS NOT NULL")
    named = rows.select(F.col("id").alias("advisory_id"), F.col("groupId").alias("group_id"), F.col("artifactId").alias("artifact_id"), F.coalesce("introduced", F.lit("")).alias("introduced"), F.coalesce("fixed", F.lit("")).alias("fixed"), "severity", "summary")
    return named.dropDuplicates(["advisory_id", "group_id", "artifact_id"])


def config_rules(spark: SparkSession, path: str) -> list[dict]:
    """Rules for ``security.config_audit``, a rule set's size."""
    rows = _documents(spark, path, CONFIG_RULE).filter("id IS NOT NULL").collect()
    return [{"rule_id": r["id"], "severity": r["severity"], "type": r["type"], "key": r["key"], "value_pattern": r["valuePattern"], "negate": bool(r["negate"])} for r in rows]


def threat_rules(spark: SparkSession, path: str) -> list[dict]:
    """Rules for ``security.log_threats``, a rule set's size."""
    rows = _documents(spark, path, THREAT_RULE).filter("id IS NOT NULL AND pattern IS NOT NULL").collect()
    return [{"rule_id": r["id"], "severity": r["severity"], "pattern": r["pattern"], "group": r["group"] or 0, "min_count": r["minCount"], "whitelist_checked": bool(r["whitelistChecked"])} for r in rows]
