"""Registered queries of functions, sources and smaller operators, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.adapters import duck, load
from graphlens.functions import code
from graphlens.operators import findings as fd
from graphlens.operators import graph, metrics, retrieval
from graphlens.plans import index
from graphlens.queries_search import _SECURITY
from graphlens.sources import files, texts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


_PATHS = """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'src/main/java/A' || CAST(p_partkey AS STRING) || '.java' WHEN 1 THEN 'docs/guide.md' WHEN 2 THEN 'target/classes/A.class' WHEN 3 THEN 'src/test/java/FooTest.java' WHEN 4 THEN 'data/x' || CAST(p_partkey AS STRING) || '.bin'
WHEN 5 THEN 'web/app.tsx' WHEN 6 THEN 'README.rst' WHEN 7 THEN 'lib/util.spec.js' ELSE 'native/core.hpp' END AS file_path FROM {part}"""
_CATEGORY = """CASE WHEN regexp_matches(lower(file_path), '(^|/)(target|build|out|dist|node_modules|vendor|__pycache__|generated|generated-sources|\\.git|\\.gradle|\\.idea|\\.vscode)(/|$)') THEN 'GENERATED'
WHEN regexp_matches(lower(file_path), '(^|/)(test|tests|__tests__|spec)(/|$)') OR regexp_matches(lower(file_path), '(test|tests|spec)\\.[^./]+$') THEN 'TEST'
WHEN regexp_matches(lower(file_path), '(^|/)docs?/') OR regexp_matches(lower(file_path), '\\.(md|markdown|rst|adoc|asciidoc|txt)$') THEN 'DOCUMENTATION'
WHEN regexp_matches(lower(file_path), '\\.(java|tsx|hpp|js|class)$') AND NOT regexp_matches(lower(file_path), 'class$') THEN 'BUSINESS' ELSE 'UNKNOWN' END"""
_LANG = "CASE WHEN regexp_matches(file_path, '\\.java$') THEN 'java' WHEN regexp_matches(file_path, '\\.tsx$') THEN 'typescript' WHEN regexp_matches(file_path, '\\.js$') THEN 'javascript' WHEN regexp_matches(file_path, '\\.hpp$') THEN 'cpp' WHEN regexp_matches(file_path, '\\.class$') THEN 'class' WHEN regexp_matches(file_path, '\\.md$') THEN 'doc' END"


def _paths(spark, sf_dir):
    return spark.sql(_PATHS, part=load(spark, sf_dir, "part"))


@query(f"SELECT p_partkey, file_path, {_CATEGORY} AS category FROM ({_PATHS.replace('{part}', 'part')})")
def p15_file_categories(spark, sf_dir):
    return _paths(spark, sf_dir).select("p_partkey", "file_path", files.classified(F.col("file_path")).alias("category"))


@query(f"SELECT p_partkey, {_LANG} AS language FROM ({_PATHS.replace('{part}', 'part')})")
def s2_languages(spark, sf_dir):
    return _paths(spark, sf_dir).select("p_partkey", files.language(F.col("file_path")).alias("language"))


@query(f"SELECT p_partkey, file_path FROM ({_PATHS.replace('{part}', 'part')}) WHERE NOT contains(file_path, 'target/') AND {_LANG} NOT IN ('doc', 'class')")
def s1_scanned_files(spark, sf_dir):
    return _paths(spark, sf_dir).filter(files.included(F.col("file_path")))


#: Languages of an asset's files, written out: documents and bytecode have none.
_FILE_LANG = "CASE WHEN regexp_matches(file_path, '\\.java$') THEN 'java' WHEN regexp_matches(file_path, '\\.tsx$') THEN 'typescript' WHEN regexp_matches(file_path, '\\.js$') THEN 'javascript' WHEN regexp_matches(file_path, '\\.hpp$') THEN 'cpp' END"


@query("SELECT p_partkey, CASE p_partkey % 25 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate("java kotlin kotlin c cpp python javascript typescript go rust php ruby swift csharp solidity scala groovy yaml yaml xml json toml properties dockerfile".split())) + " END AS language FROM part")
def p16_file_languages(spark, sf_dir):
    names = "A.java b.kt b.kts c.h d.hpp e.py f.jsx g.tsx h.go i.rs j.php k.rb l.swift m.cs n.sol o.scala p.groovy q.yml q.yaml r.xml s.json t.toml u.properties Dockerfile v.unknown".split()
    path = F.concat(F.lit("src/"), F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 25 + 1).cast("int")))
    return load(spark, sf_dir, "part").select("p_partkey", files.file_language(path).alias("language"))


@query(f"SELECT 'category' AS bucket, {_CATEGORY} AS key, count(*) AS n FROM ({_PATHS.replace('{part}', 'part')}) GROUP BY 2 UNION ALL SELECT 'language', {_FILE_LANG} AS l, count(*) FROM ({_PATHS.replace('{part}', 'part')}) WHERE l IS NOT NULL GROUP BY 2")
def a11_asset_distributions(spark, sf_dir):
    return files.distributions(_paths(spark, sf_dir))


#: Which scanners take a language, written out.
_TAKES = {"GRAPH_CODE": "java python", "GRAPH_TAINT": "java", "SEMGREP": "java solidity python go cpp", "CODEQL": "java python csharp", "SLITHER": "solidity"}
_PLAN = "WITH f AS (SELECT n_nationkey AS project_id, ['java', 'solidity', 'python', 'go', 'csharp', 'cpp', '', 'swift'][n_nationkey % 8 + 1] AS lang, CASE WHEN n_nationkey % 3 = 0 THEN 'maven' ELSE '' END AS build FROM nation) " + " UNION ALL ".join(
    [f"SELECT project_id, '{s}' AS scanner, lang IN ({', '.join(repr(x) for x in v.split())}) AS selected, 'AUTO' AS source FROM f" for s, v in _TAKES.items()]
    + ["SELECT project_id, 'PRECISE_TAINT', lang = 'java' AND build = 'maven', 'AUTO' FROM f", "SELECT project_id, 'DEPENDENCY_CVE', build <> '', 'AUTO' FROM f"]
)


def _facts(spark, sf_dir):
    k = F.col("n_nationkey")
    langs = F.array(*map(F.lit, ("java", "solidity", "python", "go", "csharp", "cpp", "", "swift")))
    one = F.element_at(langs, (k % 8 + 1).cast("int"))
    none = F.array().cast("array<string>")
    return load(spark, sf_dir, "nation").select(k.alias("project_id"), F.when(one == "", none).otherwise(F.array(one)).alias("languages"), F.when(k % 3 == 0, F.array(F.lit("maven"))).otherwise(none).alias("builds"))


@query(_PLAN)
def p17_scanner_plan(spark, sf_dir):
    return files.scanner_plan(_facts(spark, sf_dir))


@query(f"SELECT project_id, scanner, CASE scanner WHEN 'SEMGREP' THEN true WHEN 'CODEQL' THEN false ELSE selected END AS selected, CASE scanner WHEN 'SEMGREP' THEN 'INCLUDE_OVERRIDE' WHEN 'CODEQL' THEN 'EXCLUDE_OVERRIDE' ELSE source END AS source FROM ({_PLAN})")
def p17_scanner_overrides(spark, sf_dir):
    return files.scanner_plan(_facts(spark, sf_dir), include=["SEMGREP", "CODEQL"], exclude=["CODEQL"])


@query("SELECT 'f' || CAST(o_custkey % 40 AS VARCHAR) || '/a.java' AS file_path, count(*) AS changes FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1")
def s12_churn(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    line = F.when(o["o_orderkey"] % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit("f"), (o["o_custkey"] % 40).cast("string"), F.lit("\\a.java ")))
    return files.churn(o.select(line.alias("value")))


@query("SELECT p_partkey, 'd' || CAST(p_partkey AS VARCHAR) || '#' || s AS qualified_name FROM part, (VALUES ('One'), ('Two'), ('One-L5')) t(s) WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'd' || CAST(p_partkey AS VARCHAR) || '#d' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 2 = 1")
def s3_sections(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    k = F.col("p_partkey")
    text = F.when(k % 2 == 0, F.lit("# One\ntext\n## Two\nmore\n### One\n#### deep\n")).otherwise("plain\ntext")
    docs = part.select(F.concat(F.lit("d"), k.cast("string")).alias("file_path"), text.alias("content"))
    return texts.sections(docs).select(F.substring("file_path", 2, 9).cast("long").alias("p_partkey"), "qualified_name")


@query(duck("SELECT id, CASE WHEN contains(qualified_name, '()') THEN 0 WHEN contains(qualified_name, '(') THEN len(string_split(qualified_name, ',')) END AS arity, CASE WHEN contains(qualified_name, '#') THEN regexp_replace(qualified_name, '^.*\\.([^.#]*)#([^(]*).*$', '\\1#\\2') END AS simple, regexp_extract(split_part(qualified_name, '#', 1), '^(.*)\\.[^.]*$', 1) AS package FROM units WHERE num IS NOT NULL"))
def f4_name_parts(spark, sf_dir):
    own = load(spark, sf_dir, "units").filter("num IS NOT NULL")
    return own.select("id", graph.arity(F.col("qualified_name")).alias("arity"), code.simple_method(F.col("qualified_name")).alias("simple"), graph.package_of(F.substring_index("qualified_name", "#", 1)).alias("package"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'click' THEN 'UNKNOWN' WHEN 'purchase' THEN 'UNKNOWN' ELSE 'UNKNOWN' END AS plain, CASE event_id % 6 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' WHEN 3 THEN 'INFO' WHEN 4 THEN 'CRITICAL' ELSE 'UNKNOWN' END AS severity, CASE WHEN event_id % 4 = 0 THEN 'CWE-' || CAST(event_id AS VARCHAR) END AS cwe FROM events")
def f11_severity_and_cwe(spark, sf_dir):
    e, i = load(spark, sf_dir, "events"), F.col("event_id")
    raw = F.when(i % 6 == 0, "Major").when(i % 6 == 1, " warning ").when(i % 6 == 2, "minor").when(i % 6 == 3, "note").when(i % 6 == 4, "Blocker").otherwise(F.lit(None))
    text = F.when(i % 4 == 0, F.concat(F.lit("see cwe_"), i.cast("string"), F.lit(" x"))).otherwise("none")
    return e.select("event_id", code.severity(F.col("event_type")).alias("plain"), code.severity(raw).alias("severity"), code.cwe(text).alias("cwe"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'pkg:npm/%40s/a' || CAST(p_partkey AS VARCHAR) || '@1.0' WHEN 1 THEN 'pkg:pypi/my-lib' || CAST(p_partkey AS VARCHAR) ELSE 'pkg:maven/g/My_Lib' || CAST(p_partkey AS VARCHAR) || '@1.0' END AS purl FROM part")
def f14_package_addresses(spark, sf_dir):
    k = F.col("p_partkey")
    eco = F.when(k % 3 == 0, "npm").when(k % 3 == 1, "pip").otherwise("maven")
    name = F.concat(F.when(k % 3 == 0, "@s/a").otherwise("My_Lib"), k.cast("string"))
    return load(spark, sf_dir, "part").select("p_partkey", code.purl(eco, F.lit("g"), name, F.when(k % 3 == 1, "").otherwise("1.0")).alias("purl"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '/a' || CAST(n_nationkey AS VARCHAR) WHEN n_nationkey % 3 = 1 THEN '/api/x/b' ELSE '/api' END AS route, 'asia.X' AS short FROM nation")
def f19_routes(spark, sf_dir):
    k = F.col("n_nationkey")
    outer = F.when(k % 3 == 0, F.lit(" ")).when(k % 3 == 1, "api//x/").otherwise("\\api")
    inner = F.when(k % 3 == 0, F.concat(F.lit("a"), k.cast("string"))).when(k % 3 == 1, "/b/").otherwise(F.lit(None))
    return load(spark, sf_dir, "nation").select("n_nationkey", code.joined_route(outer, inner).alias("route"), code.short_package(F.lit("com.asia.X")).alias("short"))


@query("SELECT event_id, 'n=' || CAST(user_id AS VARCHAR) || ' by ' || event_type || ' and ' AS detail FROM events")
def f21_templates(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", code.filled(F.lit("n={count} by {1} and {2}"), F.col("user_id"), F.array("event_type", F.lit(None).cast("string"))).alias("detail"))


@query("SELECT n_nationkey, n_nationkey % 4 IN (0, 1) AS ok FROM nation")
def f24_rule_gate(spark, sf_dir):
    k = F.col("n_nationkey")
    kind, pattern = F.when(k % 2 == 0, "SUBSTRING").otherwise("REGEX"), F.when(k % 2 == 0, "a.b").otherwise("a.b")
    negative = F.when(k % 4 == 2, F.array(F.lit("xa.by"))).when(k % 4 == 3, F.array(F.lit("a\nb"))).otherwise(F.array(F.lit("none")))
    return load(spark, sf_dir, "nation").select("n_nationkey", code.regression_ok(kind, pattern, F.array(F.lit("xx a.b yy")), negative).alias("ok"))


@query(duck("SELECT id, CASE WHEN contains(signature, 'int b') THEN '0,1' WHEN contains(signature, 'String a') THEN '0' ELSE '' END AS params, contains(lower(annotations), '@getmapping') AS entry FROM units WHERE num IS NOT NULL"))
def p14_entries_and_parameters(spark, sf_dir):
    own = load(spark, sf_dir, "units").filter("num IS NOT NULL")
    return own.select("id", F.array_join(F.transform(code.user_parameters(F.col("signature")), lambda i: i.cast("string")), ",").alias("params"), code.is_http_entry(F.col("annotations")).alias("entry"))


@query(
    "SELECT count(*) AS samples, avg(CASE WHEN event_id % 3 = event_id % 2 THEN 1.0 ELSE 0.0 END) AS heuristic_accuracy, count(*) FILTER (event_type = 'view' AND event_id % 7 <> 0) AS available,"
    " avg(CASE WHEN event_id % 5 = event_id % 2 THEN 1.0 ELSE 0.0 END) FILTER (event_type = 'view' AND event_id % 7 <> 0) AS advice_accuracy, round(avg(user_id) FILTER (event_type = 'view' AND event_id % 7 <> 0), 6) AS mean_latency, CAST(count(*) FILTER (event_type = 'view' AND event_id % 7 <> 0) * 0.5 AS DOUBLE) AS total_cost FROM events"
)
def a9_advice_evaluation(spark, sf_dir):
    i = F.col("event_id")
    s = load(spark, sf_dir, "events").select((i % 3).cast("string").alias("heuristic"), (i % 2).cast("string").alias("expected"), F.when(i % 7 != 0, (i % 5).cast("string")).alias("suggested"), F.when(F.col("event_type") == "view", "COMPLETED").otherwise("FAILED").alias("status"), F.col("user_id").alias("latency"), F.lit(0.5).alias("cost"))
    return fd.evaluate_advice(s).withColumn("mean_latency", F.round("mean_latency", 6))


_FIRST = "(SELECT string_agg(e, ',' ORDER BY {by}) FROM (SELECT * FROM {rows} ORDER BY {by} LIMIT 20))"


@query(
    duck(
        f"SELECT 'PUBLIC_HTTP_ENTRY' AS signal, count(*) AS n, 'MEDIUM' AS severity, {_FIRST.format(by='place, e', rows='entry_places')} AS evidence FROM own WHERE is_entry_point"
        f" UNION ALL SELECT 'DANGEROUS_SINK', count(*), 'HIGH', {_FIRST.format(by='place, e', rows='sink_places')} FROM sinks"
        f" UNION ALL SELECT 'SENSITIVE_CONFIG', count(*), 'HIGH', {_FIRST.format(by='e', rows='config')} FROM config"
        f" UNION ALL SELECT 'DEPENDENCY_CVE', count(*), 'CRITICAL', {_FIRST.format(by='e', rows='cve_titles')} FROM cve"
        f" UNION ALL SELECT 'HIGH_CHURN_HOTSPOT', count(*), 'MEDIUM', (SELECT string_agg(e, ',' ORDER BY score DESC, e) FROM hot) FROM hot",
        own="SELECT *, file_path || ':' || CAST(start_line AS VARCHAR) AS e, (file_path, start_line, id) AS place FROM units WHERE project_id = 'p1'",
        entry_places="SELECT e, min(place) AS place FROM own WHERE is_entry_point GROUP BY 1",
        sinks="SELECT * FROM own WHERE kind IN ('METHOD', 'CONSTRUCTOR', 'FUNCTION') AND (contains(raw_source, 'Runtime.getRuntime().exec') OR contains(raw_source, 'executeQuery(') OR contains(raw_source, 'readObject('))",
        sink_places="SELECT e, min(place) AS place FROM sinks GROUP BY 1",
        config="SELECT 'conf/' || CAST(s_suppkey AS VARCHAR) || CASE s_suppkey % 3 WHEN 0 THEN '.yml' WHEN 1 THEN '/.env' END AS e FROM supplier WHERE s_suppkey % 3 < 2 AND s_suppkey % 2 = 0 AND s_suppkey % 5 > 0",
        cve="SELECT 'cve ' || fingerprint AS e FROM findings WHERE project_id = 'p1' AND rule_id = 'SQL_INJECTION' AND status IN ('SUSPECTED', 'CONFIRMED')",
        cve_titles="SELECT DISTINCT e FROM cve",
        churn="SELECT 'src/' || lower(replace(r_name, ' ', '')) || '/' || replace(n_name, ' ', '') || '.java' AS e, n_nationkey AS score FROM nation JOIN region ON n_regionkey = r_regionkey",
        hot="SELECT * FROM churn ORDER BY score DESC, e LIMIT 10",
    )
)
def a12_risk_signals(spark, sf_dir):
    s, findings = F.col("s_suppkey"), load(spark, sf_dir, "findings").filter("project_id = 'p1'")
    path = F.concat(F.lit("conf/"), s.cast("string"), F.when(s % 3 == 0, ".yml").when(s % 3 == 1, "/.env").otherwise(".txt"))
    config = load(spark, sf_dir, "supplier").select(path.alias("file_path"), F.when(s % 5 == 0, "GENERATED").otherwise("BUSINESS").alias("category"), F.lit(10).alias("size"), F.when(s % 2 == 0, "db.PASSWORD=x").otherwise("a=b").alias("content"))
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    hot = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("src/"), F.lower(F.replace("r_name", F.lit(" "), F.lit(""))), F.lit("/"), F.replace("n_name", F.lit(" "), F.lit("")), F.lit(".java")).alias("file_path"), F.col("n_nationkey").alias("score"))
    known = findings.withColumn("rule_id", F.when(F.col("rule_id") == "SQL_INJECTION", "DEP_VULNERABILITY").otherwise(F.col("rule_id")))
    titled = known.select("rule_id", "status", "severity", F.concat(F.lit("cve "), "fingerprint").alias("title"), F.col("unit_id").alias("qualified_name"))
    return fd.risk_signals(load(spark, sf_dir, "units").filter("project_id = 'p1'"), config, titled, hot)


@query("SELECT conv_id AS case_id, 'a' AS kept, CAST(conv_id % 3 AS VARCHAR) AS rejected FROM (SELECT DISTINCT conv_id FROM conversations)")
def s5_citation_whitelist(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id")).distinct()
    got = fd.whitelisted(c.withColumn("cited", F.array(F.lit("a"), (F.col("case_id") % 3).cast("string"))), c.withColumn("known", F.array(F.lit("a"), F.lit("b"))))
    return got.select("case_id", F.array_join("kept", ",").alias("kept"), F.array_join("rejected", ",").alias("rejected"))


@query(
    duck(
        "SELECT finding_id, qualified_name, relation, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY finding_id, qualified_name ORDER BY stage) AS r FROM allrows) WHERE r = 1",
        sec=f"SELECT id, qualified_name, CAST({_SECURITY} AS DOUBLE) AS security FROM units",
        own="SELECT id AS finding_id, unit_id FROM findings",
        seeds="SELECT DISTINCT unit_id FROM findings",
        calls="SELECT DISTINCT src, dst FROM edges WHERE kind = 'CALLS'",
        links="SELECT DISTINCT dst AS src, src AS dst FROM edges WHERE kind IN ('CALLS', 'DEFINES_TYPE', 'OVERRIDES', 'EXTENDS', 'IMPLEMENTS')",
        callers="SELECT unit_id, qualified_name, security, row_number() OVER (PARTITION BY unit_id ORDER BY qualified_name, sec.id) AS r FROM seeds JOIN calls ON dst = unit_id JOIN sec ON sec.id = src",
        callees="SELECT unit_id, qualified_name, security, row_number() OVER (PARTITION BY unit_id ORDER BY qualified_name, sec.id) AS r FROM seeds JOIN calls ON src = unit_id JOIN sec ON sec.id = dst",
        near="SELECT unit_id, qualified_name, 0 AS stage, 'FINDING' AS relation, 1.0 + 0.5 * security AS score FROM seeds JOIN sec ON sec.id = unit_id UNION ALL SELECT unit_id, qualified_name, 1, 'CALLER', 0.6 + 0.5 * security FROM callers WHERE r <= 20 UNION ALL SELECT unit_id, qualified_name, 2, 'CALLEE', 0.5 + 0.5 * security FROM callees WHERE r <= 20",
        back="SELECT unit_id, dst AS id FROM seeds JOIN links ON src = unit_id UNION SELECT unit_id, l.dst FROM back JOIN links l ON l.src = back.id",
        others="SELECT unit_id, sec.* FROM back JOIN sec USING (id) WHERE security > 0",
        more="SELECT unit_id, others.qualified_name, security, row_number() OVER (PARTITION BY unit_id ORDER BY others.qualified_name, id) AS r FROM others ANTI JOIN near USING (unit_id, qualified_name)",
        units_="SELECT * FROM near UNION ALL SELECT unit_id, qualified_name, 3, 'IMPACT', 0.2 + 0.5 * security FROM more WHERE r <= 20",
        allrows="SELECT finding_id, qualified_name, stage, relation, score FROM own JOIN units_ USING (unit_id)",
    )
)
def v8_finding_context(spark, sf_dir):
    findings = load(spark, sf_dir, "findings")
    f = findings.select(F.col("id").alias("finding_id"), "unit_id")
    return retrieval.finding_context(f, load(spark, sf_dir, "units"), load(spark, sf_dir, "edges")).withColumn("score", F.round("score", 6))


@query(duck("SELECT id, CASE WHEN status IN ('SUSPECTED', 'CONFIRMED') AND event_id % 2 = 0 AND event_id % 3 > 0 THEN 'PARTIAL' WHEN status IN ('SUSPECTED', 'CONFIRMED') THEN 'FAILED' ELSE status END AS status FROM findings"))
def d11_recovery(spark, sf_dir):
    f = load(spark, sf_dir, "findings")
    open_ = f.withColumn("was", F.col("status")).withColumn("status", F.when(F.col("status").isin("SUSPECTED", "CONFIRMED"), F.when(F.col("event_id") % 5 == 0, "QUEUED").otherwise("RUNNING")).otherwise(F.col("status")))
    tasks = open_.withColumns({"kind": F.when(F.col("event_id") % 2 == 0, "AGENT").otherwise("SCAN"), "steps_done": F.col("event_id") % 3})
    return index.recovered(tasks).select("id", "status")


@query("SELECT n_nationkey AS project_id, n_nationkey % 4 <> 1 AS accepted FROM nation")
def d12_index_admission(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"))
    return index.admitted(n.withColumn("status", F.when(F.col("project_id") % 4 == 1, "running").otherwise("done")), n)


@query(duck("SELECT src, dst, kind FROM edges WHERE src NOT IN (SELECT id FROM units WHERE project_id = 'p1' AND simple_name = 'run7') AND dst NOT IN (SELECT id FROM units WHERE project_id = 'p1' AND simple_name = 'run7') AND dst IN (SELECT id FROM units)"))
def d1_replace_files(spark, sf_dir):
    units, edges = load(spark, sf_dir, "units"), load(spark, sf_dir, "edges")
    own = units.withColumn("file_path", F.concat("id", F.lit(".java")))
    gone = own.filter("project_id = 'p1' AND simple_name = 'run7'").select("project_id", "file_path")
    raw = spark.createDataFrame([], "source_id string, target_ref string, kind string, file_path string, source_line int, seq long")
    return index.replace_files(own, edges, gone, own.limit(0), raw)[1]


@query(duck("SELECT id, file_path FROM units WHERE project_id = 'p1' AND qualified_name = (SELECT qualified_name FROM units WHERE id = 'm1') ORDER BY file_path, id LIMIT 1"))
def p4_find_symbol(spark, sf_dir):
    units = load(spark, sf_dir, "units")
    return retrieval.symbol(units, units.filter("id = 'm1'").first()["qualified_name"], "p1").select("id", "file_path")


@query(duck("SELECT q.kind, CAST(q.n AS BIGINT) AS n FROM (SELECT kind, count(*) AS n FROM units WHERE project_id = 'p1' GROUP BY 1) q ORDER BY n DESC"))
def a1_kinds(spark, sf_dir):
    return metrics.project_stats(load(spark, sf_dir, "units"), load(spark, sf_dir, "edges"), "p1").filter("bucket = 'kind'").select(F.col("key").alias("kind"), "n")
