"""Taint propagation over method summaries, and routes to resources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.code import is_http_entry, user_parameters
from graphlens.operators.graph import held, scan_targets
from graphlens.plans.lineage import Visited

MAX_METHODS, MAX_PATHS, MAX_ENTRIES, MAX_DEPTH = 200, 50, 80, 12

#: Sink methods and the rule, weakness and severity that reaching one means.
SINK_RULES = {
    "executeQuery": ("SQL_INJECTION_TAINT", "CWE-89", "HIGH"),
    "executeUpdate": ("SQL_INJECTION_TAINT", "CWE-89", "HIGH"),
    "executeBatch": ("SQL_INJECTION_TAINT", "CWE-89", "HIGH"),
    "executeLargeUpdate": ("SQL_INJECTION_TAINT", "CWE-89", "HIGH"),
    "execute": ("SQL_INJECTION_TAINT", "CWE-89", "HIGH"),
    "exec": ("COMMAND_INJECTION_TAINT", "CWE-78", "HIGH"),
    "start": ("COMMAND_INJECTION_TAINT", "CWE-78", "HIGH"),
    "readObject": ("INSECURE_DESER_TAINT", "CWE-502", "HIGH"),
    "readUnshared": ("INSECURE_DESER_TAINT", "CWE-502", "HIGH"),
    "deserialize": ("INSECURE_DESER_TAINT", "CWE-502", "HIGH"),
    "loadClass": ("UNSAFE_REFLECTION_TAINT", "CWE-470", "HIGH"),
    "forName": ("UNSAFE_REFLECTION_TAINT", "CWE-470", "HIGH"),
    "invoke": ("UNSAFE_REFLECTION_TAINT", "CWE-470", "HIGH"),
    "newInstance": ("UNSAFE_REFLECTION_TAINT", "CWE-470", "HIGH"),
    "lookup": ("JNDI_INJECTION_TAINT", "CWE-917", "CRITICAL"),
    "write": ("XSS_TAINT", "CWE-79", "MEDIUM"),
    "print": ("XSS_TAINT", "CWE-79", "MEDIUM"),
    "println": ("XSS_TAINT", "CWE-79", "MEDIUM"),
    "sendRedirect": ("OPEN_REDIRECT_TAINT", "CWE-601", "MEDIUM"),
    "sendError": ("XSS_TAINT", "CWE-79", "MEDIUM"),
    "parse": ("XXE_TAINT", "CWE-611", "HIGH"),
    "search": ("LDAP_INJECTION_TAINT", "CWE-90", "HIGH"),
}
UNKNOWN_SINK = ("TAINT_SINK", "CWE-XX", "HIGH")

#: Accesses to resources, as (kind, target, pattern of the source).
RESOURCES = [
    ("DATABASE", "queryForObject", r"\bqueryForObject\s*\("),
    ("DATABASE", "executeQuery", r"\bexecuteQuery\s*\("),
    ("DATABASE", "executeUpdate", r"\bexecuteUpdate\s*\("),
    ("DATABASE", "repository.findBy", r"(?i)\b\w*repository\s*\.\s*findBy\w*\s*\("),
    ("DATABASE", "repository.save", r"(?i)\b\w*repository\s*\.\s*save\w*\s*\("),
    ("FILE", "Files API", r"\bFiles\s*\.\s*(read|write|copy|move|delete)\w*\s*\("),
    ("FILE", "file stream", r"\b(FileInputStream|FileOutputStream)\s*\("),
    ("NETWORK", "HTTP client", r"\b(RestTemplate|WebClient|HttpClient|URLConnection)\b"),
    ("DANGEROUS_SINK", "Runtime.exec", r"\bRuntime\s*\.\s*getRuntime\s*\(\s*\)\s*\.\s*exec\s*\("),
    ("DANGEROUS_SINK", "ProcessBuilder", r"\bnew\s+ProcessBuilder\s*\("),
    ("DANGEROUS_SINK", "ScriptEngine.eval", r"\b\w*Engine\s*\.\s*eval\s*\("),
]


def _with_room(new: DataFrame, visited: DataFrame, key: list[str], limit: int) -> DataFrame:
    """The states that still have a place among ``limit`` of their key, in the order of their paths, and one marked
    ``kept`` = false where others have none.  Paths of one length in order are a queue's order."""
    have = visited.groupBy(*key).agg(F.count("*").alias("have"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("path")) + F.coalesce("have", F.lit(0))
    return new.join(have, key, "left").withColumn("place", place).filter(F.col("place") <= limit + 1).withColumn("kept", F.col("place") <= limit).drop("have", "place")


def taint(summaries: DataFrame, calls: DataFrame, entries: DataFrame, depth: int = 6, max_methods: int = MAX_METHODS, max_paths: int = MAX_PATHS) -> tuple[DataFrame, DataFrame]:
    """Paths (entry, param, end, sink, depth, path) of taint from entries (entry, param), and a row an entry: (entry,
    param, methods, truncated).

    Summaries (method, from_param, kind, callee, to_index): kind SINK and RETURN end a path, CALL_ARG follows the callees of
    that simple name (calls: method, callee_method, callee_name).  All entries go forward together, a level a step: each
    (entry, param) visits a (method, param) once, first come first served in the order of paths, and no more than
    ``max_methods`` of them, ``depth`` calls deep; of its paths the first ``max_paths`` are given.  An entry is truncated if
    any of the three bounds left something out.
    """
    key = ["entry", "param"]
    start = F.array(F.concat_ws(":", "entry", F.col("param").cast("string")))
    first = entries.select(*key, F.col("entry").alias("method"), F.col("param").alias("at"), start.alias("path"), F.lit(0).alias("depth"), F.lit(True).alias("kept")).distinct()
    passed = summaries.filter("kind = 'CALL_ARG'").select("method", F.col("from_param").alias("at"), "callee", "to_index")
    hops = held(passed.join(calls.withColumnRenamed("callee_name", "callee"), ["method", "callee"]).select("method", "at", "callee_method", "to_index").distinct(), "method", "at")
    visited = Visited(first)
    for d in range(1, depth + 1):
        frontier = visited.rows().filter((F.col("depth") == d - 1) & F.col("kept")).drop("depth", "kept")
        follow = frontier.join(hops, ["method", "at"]).select(*key, F.col("callee_method").alias("method"), F.col("to_index").alias("at"), "path")
        known = visited.rows().filter("kept")
        one = follow.join(known, [*key, "method", "at"], "left_anti").groupBy(*key, "method", "at").agg(F.min("path").alias("path"))
        step = one.withColumn("path", F.array_append("path", F.concat_ws(":", "method", F.col("at").cast("string"))))
        if not visited.add(_with_room(step, known, key, max_methods).withColumn("depth", F.lit(d))):
            break
    hops.unpersist()
    states = visited.rows()
    kinds = summaries.filter("kind IN ('SINK', 'RETURN')").select("method", F.col("from_param").alias("at"), "kind", "callee").distinct()
    ends = states.filter("kept").join(kinds, ["method", "at"])
    ends = ends.select(*key, F.col("kind").alias("end"), F.when(F.col("kind") == "SINK", F.col("callee")).alias("sink"), (F.col("depth") + 1).alias("depth"), "path").distinct()
    ranked = ends.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("depth", "path", "end", F.coalesce("sink", F.lit("")))))
    deep = states.filter((F.col("depth") == depth) & F.col("kept")).join(passed.select("method", "at").distinct(), ["method", "at"], "left_semi").select(*key)
    many = ranked.filter(F.col("r") == max_paths + 1).select(*key)
    cut_short = deep.unionByName(many).unionByName(states.filter("NOT kept").select(*key)).distinct().withColumn("truncated", F.lit(True))
    runs = states.groupBy(*key).agg(F.count_if("kept").alias("methods")).join(cut_short, key, "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    return ranked.filter(F.col("r") <= max_paths).drop("r"), runs


def taint_paths(summaries: DataFrame, calls: DataFrame, entries: DataFrame, depth: int = 6, max_methods: int = MAX_METHODS, max_paths: int = MAX_PATHS) -> DataFrame:
    """The paths of ``taint``."""
    return taint(summaries, calls, entries, depth, max_methods, max_paths)[0]


def http_entries(units: DataFrame, project_id: str, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(entry, param): parameters that a user controls of the project's HTTP entries, the first ``max_entries`` by file and line."""
    found = scan_targets(units, project_id).filter(is_http_entry(F.col("raw_source")))
    first = found.orderBy("file_path", "start_line", "id").limit(max_entries)
    return first.select(F.col("id").alias("entry"), F.explode(user_parameters(F.col("signature"))).alias("param"))


def taint_findings(paths: DataFrame, project_id: str) -> DataFrame:
    """One finding for each (entry, param, sink) that a path reaches, by its first path."""
    at = F.create_map(*[F.lit(x) for s, r in SINK_RULES.items() for x in (s, "|".join(r))])
    one = paths.filter("end = 'SINK'").groupBy("entry", "param", "sink").agg(F.min(F.struct("depth", "path")).alias("p"))
    rule = F.split(F.coalesce(F.element_at(at, F.col("sink")), F.lit("|".join(UNKNOWN_SINK))), r"\|")
    named = one.select("entry", "param", "sink", "p.depth", "p.path", rule[0].alias("rule_id"), rule[1].alias("cwe"), rule[2].alias("severity"))
    return named.withColumn("finding_id", F.substring(F.sha2(F.concat_ws(":", F.lit(project_id), "rule_id", "entry", F.col("param").cast("string"), "sink"), 256), 1, 16))


def evidence(findings: DataFrame) -> DataFrame:
    """Steps of each finding's path: SOURCE, PROPAGATION, SINK."""
    steps = findings.select("finding_id", "sink", F.size("path").alias("n"), F.posexplode("path").alias("i", "step"))
    hop = steps.select("finding_id", (F.col("i") + 1).alias("sequence"), F.when(F.col("i") == 0, "SOURCE").otherwise("PROPAGATION").alias("role"), "step")
    last = findings.select("finding_id", (F.size("path") + 1).alias("sequence"), F.lit("SINK").alias("role"), F.col("sink").alias("step"))
    return hop.unionByName(last)


def routes(edges: DataFrame, roots: DataFrame, depth: int = MAX_DEPTH, max_methods: int = MAX_METHODS) -> DataFrame:
    """(root, id, depth, path) reached from each root by calls, the root included; the first ``max_methods`` in a queue's order."""
    calls = held(edges.filter("kind = 'CALLS'").select("src", "dst").distinct(), "src")
    visited = Visited(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.array("id").alias("path"), F.lit(True).alias("kept")).distinct())
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        known = visited.rows().filter("kept")
        frontier = known.filter(F.col("depth") == d - 1).select("root", F.col("id").alias("src"), "path")
        new = frontier.join(calls, "src").select("root", F.col("dst").alias("id"), "path").join(known.select("root", "id"), ["root", "id"], "left_anti")
        one = new.groupBy("root", "id").agg(F.min("path").alias("path")).withColumn("path", F.array_append("path", F.col("id")))
        if not visited.add(_with_room(one, known, ["root"], max_methods).withColumn("depth", F.lit(d))):
            break
    calls.unpersist()
    return visited.rows().filter("kept").drop("kept")


def resource_accesses(found: DataFrame, units: DataFrame) -> DataFrame:
    """(root, kind, target, method, depth, path) of the resources that routes (root, id, depth, path) come to: one a
    kind, target and qualified name, by the first path."""
    marks = F.array_compact(F.array(*[F.when(F.col("raw_source").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(t).alias("target"))) for k, t, p in RESOURCES]))
    any_of = reduce(lambda a, b: a | b, [F.col("raw_source").rlike(p) for _, _, p in RESOURCES])
    own = units.filter(any_of).select("id", F.col("qualified_name").alias("method"), F.explode(marks).alias("m"))
    hits = found.join(own, "id").groupBy("root", "m.kind", "m.target", "method").agg(F.min(F.struct("depth", "path")).alias("p"))
    return hits.select("root", "kind", "target", "method", "p.depth", "p.path")
