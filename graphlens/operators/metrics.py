"""Code metrics: statistics, complexity, coupling, hotspots, package facts and the health score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.code import complexity
from graphlens.operators.graph import class_edges, cycles, dead_code, package_edges, package_of, scan_targets, test_gaps

#: Annotations that name a framework, first match first.
FRAMEWORKS = {
    "spring": ("@RestController", "@Controller", "@Service", "@Repository", "@Component", "@Configuration"),
    "mybatis": ("@Mapper",),
    "jaxrs": ("@Path",),
}


def framework(annotations: Column) -> Column:
    """The framework that comma-joined annotations name, null for none."""
    own, out = F.split(annotations, ","), F.lit(None)
    for name, marks in reversed(FRAMEWORKS.items()):
        out = F.when(F.arrays_overlap(own, F.array(*map(F.lit, marks))), F.lit(name)).otherwise(out)
    return out


def round_half_up(x: Column, digits: int) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def project_stats(units: DataFrame, edges: DataFrame, project_id: str) -> DataFrame:
    """(bucket, key, n): totals, and counts by kind, language, framework and kind of relation, in one pass over each input."""
    own = units.filter(F.col("project_id") == project_id)
    wide = own.select(F.explode(F.array(*[
        F.struct(F.lit(b).alias("bucket"), k.alias("key"))
        for b, k in (("total", F.lit("units")), ("kind", F.col("kind")), ("language", F.col("language")), ("framework", framework(F.col("annotations"))),
                     ("total", F.when(F.col("is_entry_point"), "entry_points")), ("total", F.when(F.col("is_test"), "tests")))
    ])).alias("x")).select("x.*").filter("key <> ''").groupBy("bucket", "key").agg(F.count("*").alias("n"))
    files = own.agg(F.count_distinct("file_path").alias("n")).select(F.lit("total").alias("bucket"), F.lit("files").alias("key"), "n")
    rel = edges.join(own.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.lit("edge").alias("bucket"), F.col("kind").alias("key")).agg(F.count("*").alias("n"))
    return wide.unionByName(files).unionByName(rel)


def top_complexity(units: DataFrame, project_id: str, limit: int = 20) -> DataFrame:
    """Callables of complexity above one, most complex first."""
    found = scan_targets(units, project_id).select("id", "qualified_name", "file_path", complexity(F.col("raw_source")).alias("complexity")).filter("complexity > 1")
    return found.orderBy(F.desc("complexity"), "id").limit(max(1, min(limit, 100)))


def coupling(classes: DataFrame) -> DataFrame:
    """fan_out, fan_in and instability (three digits) of each class, from distinct class edges (caller, callee)."""
    ends = classes.select(F.explode(F.array(F.struct(F.col("caller").alias("class"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("callee").alias("class"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("x")).select("x.*")
    sums = ends.groupBy("class").agg(F.sum("out").alias("fan_out"), F.sum("in").alias("fan_in"))
    return sums.withColumn("instability", round_half_up(F.col("fan_out") / (F.col("fan_out") + F.col("fan_in")), 3))


def top_coupling(classes: DataFrame, by: str = "fan_out", limit: int = 10) -> DataFrame:
    """Classes by what they use (fan_out) or by what uses them (fan_in), the other number second."""
    other = {"fan_out": "fan_in", "fan_in": "fan_out"}[by]
    return coupling(classes).orderBy(F.desc(by), F.desc(other), "class").limit(limit)


def hotspots(files: DataFrame, churn: DataFrame, limit: int = 50) -> DataFrame:
    """ln(changes + 1) times the mean complexity of each changed file, from (file_path, complexity) rows and (file_path, changes)."""
    mean = files.groupBy("file_path").agg(F.count("*").alias("methods"), F.avg("complexity").alias("mean"))
    both = mean.join(churn.filter("changes > 0"), "file_path")
    scored = both.select("file_path", "methods", "changes", round_half_up(F.col("mean"), 2).alias("avg_complexity"), round_half_up(F.log1p("changes") * F.col("mean"), 2).alias("score"))
    return scored.orderBy(F.desc("score"), "file_path").limit(limit)


def package_facts(units: DataFrame, edges: DataFrame, project_id: str, symbols: int = 5) -> DataFrame:
    """Units, entry points, cross-package class edges in and out, and the key symbols of each package."""
    own = units.filter(F.col("project_id") == project_id).withColumn("package", package_of(F.substring_index("qualified_name", "#", 1)))
    counts = own.groupBy("package").agg(F.count("*").alias("units"), F.sum(F.col("is_entry_point").cast("long")).alias("entry_points"))
    classes = class_edges(units, edges, project_id)
    flow = package_edges(classes)
    out = flow.groupBy(F.col("src").alias("package")).agg(F.sum("n").alias("outbound"))
    into = flow.groupBy(F.col("dst").alias("package")).agg(F.sum("n").alias("inbound"))
    degree = classes.groupBy("callee").agg(F.count("*").alias("n")).withColumn("package", package_of(F.col("callee")))
    keys = degree.groupBy("package").agg(F.array_join(F.slice(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("d"), F.col("callee").alias("c")))), lambda x: x["c"]), 1, symbols), ",").alias("key_symbols"))
    joined = counts.join(into, "package", "left").join(out, "package", "left").join(keys, "package", "left")
    return joined.select("package", "units", "entry_points", F.coalesce("inbound", F.lit(0)).alias("inbound"), F.coalesce("outbound", F.lit(0)).alias("outbound"), F.coalesce("key_symbols", F.lit("")).alias("key_symbols"))


def health_score(f: dict[str, Column]) -> Column:
    """100 less what findings, cycles, complexity, instability, gaps and dead code cost; never below 0."""
    cost = F.least(f["critical"] * 15, F.lit(45)) + F.least(f["high"] * 10, F.lit(40)) + F.least(f["medium"] * 5, F.lit(20)) + F.least(f["low"] * 2, F.lit(10))
    cost += F.least(f["cycles"] * 10, F.lit(30)) + F.least(f["complex"] * 2, F.lit(20)) + F.least(f["unstable"], F.lit(10))
    gap, dead = F.try_divide(f["gaps"], f["methods"]), F.try_divide(f["dead"], f["methods"])
    cost += F.when(gap > 0.7, 15).when(gap > 0.5, 10).when(gap > 0.3, 5).otherwise(0) + F.when(dead > 0.1, 5).otherwise(0)
    return F.greatest(100 - cost, F.lit(0)).cast("long")


def health(units: DataFrame, edges: DataFrame, findings: DataFrame, project_id: str) -> DataFrame:
    """One row: the counts behind the health score, and the score."""
    active = findings.filter((F.col("project_id") == project_id) & F.col("status").isin("SUSPECTED", "CONFIRMED"))
    classes = class_edges(units, edges, project_id)
    targets = scan_targets(units, project_id)
    parts = [
        active.agg(*[F.count_if(F.upper("severity") == s.upper()).alias(s) for s in ("critical", "high", "medium", "low")]),
        cycles(package_edges(classes)).agg(F.count("*").alias("cycles")),
        targets.agg(F.count_if(complexity(F.col("raw_source")) > 10).alias("complex"), F.count("*").alias("methods")),
        coupling(classes).agg(F.count_if(F.col("instability") > 0.8).alias("unstable")),
        test_gaps(units, edges, project_id).agg(F.count("*").alias("gaps")),
        dead_code(units, edges, project_id).agg(F.count("*").alias("dead")),
    ]
    one = parts[0].withColumn("k", F.lit(1))
    for p in parts[1:]:  # rows of one key: the aggregates of one project
        one = one.join(p.withColumn("k", F.lit(1)), "k")
    names = ("critical", "high", "medium", "low", "cycles", "complex", "methods", "unstable", "gaps", "dead")
    return one.select(*names, health_score({n: F.col(n) for n in names}).alias("score"))
