import pytest
from pyspark.sql import functions as F

from graphlens.functions import code


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "s string").select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "source, expected",
    [(None, 1), ("", 1), ("return x;", 1), ("if (a) { }", 2), ("if (a) { } else if (b) { }", 4), ("for (;;) { while (x) { } }", 3), ("do { } while (x);", 3), ("case 1: case 2:", 3), ("a && b || c", 3), ("x ? y : z", 2), ("IF (a)", 2)],
)
def test_complexity(spark, source, expected):
    assert one(spark, source, code.complexity(F.col("s"))) == expected


@pytest.mark.parametrize("low, high", [("1.0.0", "1.0.1"), ("1.0.9", "1.0.10"), ("1.2", "1.10"), ("1.0-SNAPSHOT", "1.0"), ("1.9", "2"), ("", "0"), ("1.0.0.1", "1.0.0.2")])
def test_versions(spark, low, high):
    row = spark.createDataFrame([(low, high)], "a string, b string").select((code.version_key(F.col("a")) < code.version_key(F.col("b"))).alias("r"))
    assert row.first()["r"]


def test_equal_versions(spark):
    row = spark.createDataFrame([("1.0", "1")], "a string, b string").select((code.version_key(F.col("a")) == code.version_key(F.col("b"))).alias("r"))
    assert row.first()["r"]


@pytest.mark.parametrize("address, entry, held", [("10.0.0.9", "10.0.0.9", True), ("10.0.7.9", "10.0.0.0/16", True), ("10.1.7.9", "10.0.0.0/16", False), ("host.x", "host.x", True), ("host.x", "10.0.0.0/8", False), ("10.0.0.300", "10.0.0.0/8", False)])
def test_whitelist(spark, address, entry, held):
    assert one(spark, address, code.in_cidr(F.col("s"), F.lit(entry))) is held


@pytest.mark.parametrize("glob, path, fits", [("src/*.java", "src/A.java", True), ("src/*.java", "src/x/A.java", False), ("src/**", "src/x/A.java", True), ("a?c", "abc", True), ("a.c", "abc", False)])
def test_globs(spark, glob, path, fits):
    assert one(spark, path, F.rlike("s", code.glob_pattern(F.lit(glob)))) is fits


def test_severity_cwe_and_redaction(spark):
    assert [one(spark, s, code.severity(F.col("s"))) for s in ("error", "Major", "moderate", "minor", "note", "x", None)] == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "UNKNOWN", "UNKNOWN"]
    assert one(spark, "see cwe_79 and CWE-89", code.cwe(F.col("s"))) == "CWE-79"
    assert one(spark, "none", code.cwe(F.col("s"))) is None
    assert one(spark, 'password = "abc", Bearer a.b-c', code.redact(F.col("s"))) == "password = [REDACTED], Bearer [REDACTED]"
    assert one(spark, "com.x.A#run(String)", code.simple_method(F.col("s"))) == "A#run"
    assert one(spark, "SINK:exec.arg[0]", code.sink_name(F.col("s"))) == "exec"
