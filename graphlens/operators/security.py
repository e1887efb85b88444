"""Rule scans: source rules, advisories, configuration and log rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.code import filled, in_cidr, short_hash, version_key


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


#: The texts that source rules look for, in lower case.
EXECUTES = (".executequery(", ".executeupdate(", '.execute("', ".execute(sql")
CONCATENATES = ('" +', '+ "', "+ '", "string.format(")
PREPARES = ("preparedstatement", "preparestatement(")
COMMANDS = ("runtime.getruntime().exec(", "runtime.getruntime( ).exec(", "new processbuilder(")
DESERIALISES = (".readobject()", "objectinputstream")
WEAK_DIGESTS = ('"md5"', '"sha-1"', '"sha1"', '("md5")')
SECRET_NAMES = ("password", "secret", "apikey", "privatekey", "accesstoken", "credential")
ASSIGNS = ('= "', "= '")
FILES = ("new file(", "paths.get(", "path.of(", "filechannel", "fileinputstream(", "fileoutputstream(")
INPUTS = ("getparameter(", "getpathinfo(", "getheader(", "requestparam", "pathvariable", "../", "..\\\\")
XML_PARSERS = ("documentbuilderfactory", "saxparserfactory", "xmlinputfactory", "transformer factory", "transformerfactory")
XML_GUARDS = ("disallow-doctype-decl", "external-general-entities", "external-parameter-entities", "setfeature(javax.xml", "setfeature(http://apache")
RANDOMS = ("new random()", "new java.util.random()", "math.random()")
RANDOM_USES = ("token", "password", "secret", "nonce", "salt", "session", "key", "auth", "otp", "captcha", "uuid")
LOGS = ("log.info(", "log.debug(", "log.warn(", "log.error(", "logger.info(", "logger.debug(", "logger.warn(", "logger.error(", "system.out.print", "system.err.print")
LOGGED = ("password", "passwd", "secret", "token", "apikey", "credential", "privatekey", "accesskey")


def source_rules(source: Column) -> list[tuple[str, str, str, Column]]:
    """(rule, CWE, severity, condition) of each rule over a source text."""
    low = F.lower(source)
    return [
        ("SQL_INJECTION", "CWE-89", "HIGH", _any(low, EXECUTES) & (_any(low, CONCATENATES) | ~_any(low, PREPARES))),
        ("COMMAND_INJECTION", "CWE-78", "HIGH", _any(low, COMMANDS)),
        ("INSECURE_DESERIALIZATION", "CWE-502", "HIGH", _any(low, DESERIALISES)),
        ("WEAK_CRYPTO", "CWE-327", "MEDIUM", _any(low, WEAK_DIGESTS)),
        ("HARDCODED_SECRET", "CWE-798", "HIGH", _any(low, SECRET_NAMES) & _any(low, ASSIGNS)),
        ("PATH_TRAVERSAL", "CWE-22", "HIGH", _any(low, FILES) & _any(low, INPUTS)),
        ("XXE_INJECTION", "CWE-611", "HIGH", _any(low, XML_PARSERS) & ~_any(low, XML_GUARDS)),
        ("INSECURE_RANDOM", "CWE-330", "MEDIUM", _any(low, RANDOMS) & _any(low, RANDOM_USES)),
        ("SENSITIVE_LOG", "CWE-200", "MEDIUM", F.exists(F.split(low, "\n"), lambda line: _any(line, LOGS) & _any(line, LOGGED))),
    ]


def code_scan(targets: DataFrame) -> DataFrame:
    """Findings of the source rules over callable units: one pass, no join with the rules."""
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule_id"), F.lit(w).alias("cwe"), F.lit(s).alias("severity"))) for r, w, s, c in source_rules(F.col("raw_source"))]))
    rows = targets.select("project_id", "id", "file_path", "start_line", F.explode(hits).alias("r")).select("project_id", F.col("id").alias("unit_id"), "file_path", "start_line", "r.*")
    return rows.withColumn("finding_id", short_hash(F.col("project_id"), F.col("rule_id"), F.col("unit_id")))


def affected_components(components: DataFrame, advisories: DataFrame) -> DataFrame:
    """Components of an advisory's artifact with introduced <= version < fixed; blank bounds are open, excluded scopes don't count."""
    own = components.filter("scope <> 'excluded' AND trim(group_id) <> ''").withColumn("v", version_key(F.col("version")))
    rules = advisories.select("advisory_id", "group_id", "artifact_id", F.when(F.trim("introduced") != "", version_key(F.col("introduced"))).alias("lo"), F.when(F.trim("fixed") != "", version_key(F.col("fixed"))).alias("hi"))
    both = own.join(rules, ["group_id", "artifact_id"])
    return both.filter(F.coalesce(F.col("v") >= F.col("lo"), F.lit(True)) & F.coalesce(F.col("v") < F.col("hi"), F.lit(True))).drop("v", "lo", "hi")


#: Settings that count as switched on.
ENABLED = ("yes", "on", "1", "true", "enabled")


def config_lines(files: DataFrame) -> DataFrame:
    """(name, line, key, value) of key-value lines: comments from ``#`` on, keys up to ``=`` or white space, quotes stripped."""
    rows = files.select("name", F.posexplode(F.split("content", "\r?\n")).alias("n", "text")).select("name", (F.col("n") + 1).alias("line"), F.trim(F.substring_index("text", "#", 1)).alias("text"))
    key, value = F.regexp_extract("text", r"^([^=\s]+)", 1), F.trim(F.regexp_extract("text", r"^[^=\s]+\s*(?:=|\s)\s*(.*)$", 1))
    bare = F.regexp_replace(value, r"^(?:\"(.*)\"|'(.*)')$", "$1$2")
    return rows.select("name", "line", key.alias("key"), bare.alias("value")).filter("key <> '' AND value <> ''")


def config_audit(files: DataFrame, rules: list[dict]) -> DataFrame:
    """(name, rule_id, severity, line) of violated rules (rule_id, severity, type, key, value_pattern, negate) in each file.

    Rules are data that travels with the plan: each file is expanded by them, and one equi join meets them with its lines.

    PRESENT and plain VALUE_PATTERN: no line of the key, or none with a fitting value (the first line is named);
    negated VALUE_PATTERN and FORBIDDEN: every line whose value fits, or is switched on.
    """
    whole = F.rlike("value", F.concat(F.lit(r"\A(?:"), F.col("value_pattern"), F.lit(r")\z")))
    names = ("rule_id", "severity", "type", "key", "value_pattern")
    each_rule = F.array(*[F.struct(*[F.lit(r.get(c)).cast("string").alias(c) for c in names], F.lit(bool(r.get("negate"))).alias("negate")) for r in rules])
    pairs = files.select("name", F.explode(each_rule).alias("r")).select("name", "r.*").distinct().join(config_lines(files), ["name", "key"], "left")
    bad = F.when(F.col("type") == "FORBIDDEN", F.lower("value").isin(*ENABLED)).otherwise(whole)
    listing = (F.col("type") == "FORBIDDEN") | ((F.col("type") == "VALUE_PATTERN") & F.col("negate"))
    each = pairs.filter(listing & F.coalesce(bad, F.lit(False))).select("name", "rule_id", "severity", "line")
    none = pairs.filter(~listing).groupBy("name", "rule_id", "severity").agg(F.coalesce(F.max(whole), F.lit(False)).alias("ok"), F.min("line").alias("line")).filter("not ok").select("name", "rule_id", "severity", "line")
    return each.unionByName(none).orderBy("name", F.coalesce("line", F.lit(0)), "rule_id")


def _outside(entry: str):
    return lambda v: ~in_cidr(v, F.lit(entry))


def log_threats(logs: DataFrame, rules: list[dict], whitelist: list[str]) -> DataFrame:
    """(rule_id, severity, name, line, value, n, time, detail) of threat rules over logs (name, content).

    Rules are data (rule_id, severity, pattern, group, min_count or None, whitelist_checked, perhaps time_pattern and
    detail): each is one expression over the lines.  A rule with ``min_count`` gives one row a log, at its first match, if
    it matches often enough.  The time is group 1 of the time pattern in the line; the detail is its template with {count}
    and the groups {1}, {2}, ... filled in, the rule's id where there is none.
    """
    lines = logs.select("name", F.posexplode(F.split("content", "\r?\n")).alias("n", "text")).select("name", (F.col("n") + 1).alias("line"), "text")
    out = []
    for r in rules:
        values = F.regexp_extract_all("text", F.lit(r["pattern"]), F.lit(r["group"]))
        if r.get("whitelist_checked"):
            for entry in whitelist:
                values = F.filter(values, _outside(entry))
        found = lines.filter(F.col("text").rlike(r["pattern"])).select("name", "line", F.explode(values).alias("value"), "text")
        if r.get("min_count"):
            found = found.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("line", "value", "text")).alias("f")).filter(F.col("n") >= r["min_count"]).select("name", "f.line", "f.value", "n", "f.text")
        else:
            found = found.withColumn("n", F.lit(0).cast("long"))
        time = F.nullif(F.regexp_extract("text", r["time_pattern"], 1), F.lit("")) if r.get("time_pattern") else F.lit(None).cast("string")
        groups = F.array(*[F.regexp_extract("text", r["pattern"], k + 1) for k in range(re.compile(r["pattern"]).groups)]).cast("array<string>")
        template = F.lit(r.get("detail") or r["rule_id"])
        detail = F.when(F.col("n") > 0, filled(template, F.col("n"), groups)).otherwise(filled(template, F.lit("{count}"), groups))
        out.append(found.select(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"), "name", "line", "value", "n", time.alias("time"), detail.alias("detail")))
    return reduce(DataFrame.unionByName, out).orderBy("name", "line", "rule_id", "value")


#: Dangerous sinks that variants of a finding share.
SINKS = {
    "Runtime.exec": r"\bRuntime\s*\.\s*getRuntime\s*\(\s*\)\s*\.\s*exec\s*\(",
    "ProcessBuilder": r"\bnew\s+ProcessBuilder\s*\(",
    "executeQuery": r"\bexecuteQuery\s*\(",
    "executeUpdate": r"\bexecuteUpdate\s*\(",
    "ObjectInputStream.readObject": r"\breadObject\s*\(",
    "InitialContext.lookup": r"\blookup\s*\(",
}


def source_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: F.char_length(t) >= 3))


def variants(seeds: DataFrame, units: DataFrame, limit: int = 500) -> DataFrame:
    """Units with the sink of a confirmed finding (project_id, seed_id, rule_id, unit_id, detail), by score.

    Sinks are extracted once on either side, so the match is an equi join on project and sink name.  Seeds of one rule and
    detail score alike, so they meet the units once, as a class: the classes of the first rows are among the first by their
    least seeds, and no row of the result needs more than ``limit`` seeds of a class.
    """
    limit = min(limit, 500)

    def sinks(text: Column) -> Column:
        return F.array_compact(F.array(*[F.when(text.rlike(p), F.struct(F.lit(n).alias("sink"), F.regexp_extract(text, p + r"([^)]*)\)", 1).alias("arg"))) for n, p in SINKS.items()]))

    dynamic = lambda a: (F.trim(a) != "") & ~F.trim(a).rlike(r"^(?:\"[^\"]*\"|'[^']*'|[-+]?\d+(\.\d+)?)$")
    like = ["project_id", "rule_id", "detail"]
    classes = seeds.groupBy(*like).agg(F.min("seed_id").alias("first_seed"))
    left = classes.select(*like, "first_seed", source_tokens(F.col("detail")).alias("a"), F.explode(sinks(F.col("detail"))).alias("s")).select(*like, "first_seed", "a", "s.sink", dynamic(F.col("s.arg")).alias("seed_dynamic"))
    right = units.select("project_id", F.col("id").alias("unit_id"), "raw_source", F.explode(sinks(F.col("raw_source"))).alias("s")).select("project_id", "unit_id", source_tokens(F.col("raw_source")).alias("b"), "s.sink", dynamic(F.col("s.arg")).alias("unit_dynamic"))
    known = seeds.select("project_id", "rule_id", "unit_id").distinct()
    both = left.join(right, ["project_id", "sink"]).join(known, ["project_id", "rule_id", "unit_id"], "left_anti")
    shared = F.size(F.array_intersect("a", "b"))
    alike = F.coalesce(F.try_divide(shared, F.size("a") + F.size("b") - shared), F.lit(0.0))
    score = F.least(F.lit(0.95), 0.65 + 0.25 * alike + F.when(F.col("seed_dynamic") & F.col("unit_dynamic"), 0.05).otherwise(0.0))
    rows = both.select(*like, "first_seed", "unit_id", "sink", score.alias("score")).withColumn("fingerprint", short_hash(F.col("project_id"), F.col("rule_id"), F.col("unit_id"), between="|"))
    best = rows.orderBy(F.desc("score"), "fingerprint", "first_seed", "sink").limit(limit)
    place = F.row_number().over(Window.partitionBy(*like).orderBy("seed_id"))
    own = seeds.select(*[F.col(c).alias(f"_{c}") for c in like], "seed_id")
    same = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"_{c}")), like, F.lit(True))
    first = own.join(best.select(*like).distinct(), same, "left_semi").withColumnsRenamed({f"_{c}": c for c in like}).withColumn("_r", place).filter(F.col("_r") <= limit)
    every = best.join(first.select(*[F.col(c).alias(f"_{c}") for c in like], "seed_id"), same).select("project_id", "seed_id", "rule_id", "unit_id", "sink", "score", "fingerprint")
    return every.orderBy(F.desc("score"), "fingerprint", "seed_id", "sink").limit(limit)


#: Annotations that restrict or open a route.
CONSTRAINTS = ("@PreAuthorize", "@PostAuthorize", "@Secured", "@RolesAllowed", "@PermitAll", "@DenyAll")


def authorization(methods: DataFrame, policies: DataFrame) -> DataFrame:
    """(id, source, constraint) of methods (id, route, annotations, class_annotations; annotations comma-joined).

    A method's own constraint overrides its class's; without either, a policy unit (policy_id, text) that names the route
    or covers any request decides, the least id of them; else the source is NONE.
    """
    own = lambda c: F.array_join(F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda a: a.isin(*CONSTRAINTS)), ",")
    rows = methods.select("id", "route", own("annotations").alias("m"), own("class_annotations").alias("c"))
    open_ = rows.filter("m = '' AND c = ''").select("route").distinct()
    named = policies.select("policy_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r'"(/[^"]*)"'), F.lit(1)))).alias("route"))
    by_route = open_.join(named, "route").groupBy("route").agg(F.min("policy_id").alias("by_route"))
    general = policies.filter(F.col("text").contains("anyRequest()")).agg(F.min("policy_id").alias("by_all")).withColumn("k", F.lit(1))
    both = rows.join(by_route, "route", "left").withColumn("k", F.lit(1)).join(general, "k")  # one row of the least general policy
    found = F.coalesce("by_route", "by_all")
    source = F.when(F.col("m") != "", "METHOD").when(F.col("c") != "", "CLASS").when(found.isNotNull(), "POLICY").otherwise("NONE")
    return both.select("id", source.alias("source"), F.when(F.col("m") != "", F.col("m")).when(F.col("c") != "", F.col("c")).otherwise(F.coalesce(found, F.lit(""))).alias("constraint"))


def entry_siblings(fields: DataFrame, units: DataFrame) -> DataFrame:
    """Fields (id, parent_qualified_name) whose class holds an entry point."""
    hosts = units.filter("is_entry_point").select("parent_qualified_name").distinct()
    return fields.join(hosts, "parent_qualified_name", "left_semi")
