"""Registered queries over findings, state machines, taint and the change feed, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.adapters import duck, load
from graphlens.operators import findings as fd
from graphlens.operators import flow, graph, retrieval
from graphlens.streaming.feed import bursts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query(duck("SELECT id, severity, status, rule_id FROM findings WHERE project_id = 'p1' AND severity = 'HIGH' AND status = 'SUSPECTED'"))
def p8_list_findings(spark, sf_dir):
    return fd.list_findings(load(spark, sf_dir, "findings"), "p1", "high", "suspected").select("id", "severity", "status", "rule_id")


_ENTRIES = "SELECT id, project_id, severity, CASE WHEN event_id % 2 = 0 THEN 'TRUE_RISK' ELSE 'NEEDS_REVIEW' END AS verdict, status, rule_id, found_at AS updated_at FROM findings"


def _entries(spark, sf_dir):
    return load(spark, sf_dir, "findings").withColumn("verdict", F.when(F.col("event_id") % 2 == 0, "TRUE_RISK").otherwise("NEEDS_REVIEW")).withColumnRenamed("found_at", "updated_at")


@query(duck("SELECT id, severity FROM entries WHERE project_id = 'p1' AND verdict = 'TRUE_RISK' AND status = 'CONFIRMED' AND updated_at >= TIMESTAMP '2020-01-01' ORDER BY updated_at DESC, id LIMIT 20 OFFSET 40", entries=_ENTRIES))
def p9_review_page(spark, sf_dir):
    own = fd.reviews(_entries(spark, sf_dir), "p1", verdict="TRUE_RISK", status="CONFIRMED", updated_after="2020-01-01")
    return fd.page(own, 2, 20, F.desc("updated_at"), "id").select("id", "severity")


@query(duck("SELECT count(*) AS n FROM entries WHERE project_id = 'p2' AND severity = 'HIGH' AND rule_id = 'WEAK_CRYPTO' AND updated_at >= (SELECT min(found_at) + INTERVAL 1 HOUR FROM findings) AND updated_at < (SELECT max(found_at) - INTERVAL 1 HOUR FROM findings)", entries=_ENTRIES))
def p9_review_count(spark, sf_dir):
    times = load(spark, sf_dir, "findings").agg((F.min("found_at") + F.expr("INTERVAL 1 HOUR")).cast("string").alias("a"), (F.max("found_at") - F.expr("INTERVAL 1 HOUR")).cast("string").alias("b")).first()
    return fd.reviews(_entries(spark, sf_dir), "p2", severity="HIGH", rule_id="WEAK_CRYPTO", updated_after=times["a"], updated_before=times["b"]).agg(F.count("*").alias("n"))


@query(duck("SELECT id, (SELECT count(*) FROM findings WHERE severity = 'LOW') > 40 AS has_more FROM findings WHERE severity = 'LOW' ORDER BY event_id LIMIT 20 OFFSET 20"))
def t5_page_and_more(spark, sf_dir):
    return fd.page_and_more(load(spark, sf_dir, "findings").filter("severity = 'LOW'"), 1, 20, "event_id").select("id", "has_more")


_SAID = "SELECT project_id, fingerprint, max_by(status, [CAST(epoch_us(found_at) AS VARCHAR), status]) AS feedback FROM findings WHERE event_id % 3 = 0 GROUP BY ALL"


@query(
    duck(
        "SELECT f.id AS finding_id, CASE WHEN f.project_id = 'p1' AND f.rule_id = 'SQL_INJECTION' THEN 's1' END AS suppression_id, feedback, report FROM (SELECT id, project_id, rule_id, fingerprint FROM findings WHERE unit_id IN (SELECT id FROM units)) f LEFT JOIN said USING (project_id, fingerprint) LEFT JOIN snap USING (fingerprint)",
        said=_SAID,
        snap="SELECT fingerprint, min_by(id, event_id) AS report FROM findings WHERE event_id % 5 = 0 GROUP BY 1",
    )
)
def j14_review_contexts(spark, sf_dir):
    f = load(spark, sf_dir, "findings")
    own = f.join(load(spark, sf_dir, "units").select(F.col("id").alias("unit_id"), "file_path"), "unit_id").withColumnRenamed("id", "finding_id")
    said = f.filter("event_id % 3 = 0").select("project_id", "fingerprint", "status", F.col("found_at").alias("updated_at"))
    sup = spark.createDataFrame([("s1", "p1", "SQL_INJECTION", "PROJECT", "", 1, 20, True)], "id string, project_id string, rule_id string, scope string, scope_value string, c long, e long, active boolean")
    sup = sup.withColumns({"created_at": F.timestamp_seconds("c"), "expires_at": F.timestamp_seconds("e")})
    snap = f.filter("event_id % 5 = 0").select("fingerprint", F.col("id").alias("report"), F.col("event_id").alias("created_at"))
    return fd.review_contexts(own, said, sup, snap, "1970-01-01 00:00:10").select("finding_id", "suppression_id", "feedback", "report")


@query(duck("SELECT 'total' AS bucket, 'all' AS key, count(*) AS n FROM f UNION ALL SELECT 'severity', severity, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'cwe', cwe, count(*) FROM f GROUP BY 2", f="SELECT * FROM findings WHERE project_id = 'p1'"))
def a2_report(spark, sf_dir):
    return fd.report(load(spark, sf_dir, "findings").filter("project_id = 'p1'"))


_EXTERNAL = "SELECT 'x' || CAST(event_id AS VARCHAR) AS finding_id, 'p1' AS project_id, u.file_path, CAST(10 * u.num + 10 + event_id % 12 AS INT) AS line, u.qualified_name AS symbol FROM events JOIN units u ON u.num = event_id % (SELECT count(*) FROM part) WHERE u.project_id = 'p1'"


@query(
    duck(
        "SELECT finding_id, coalesce(located, named) AS unit_id FROM ext LEFT JOIN at_line USING (finding_id) LEFT JOIN by_name ON ext.project_id = by_name.project_id AND symbol = qualified_name",
        ext=_EXTERNAL,
        at_line="SELECT finding_id, arg_min(u.id, (u.end_line - u.start_line, u.id)) AS located FROM ext e JOIN units u ON u.project_id = e.project_id AND u.file_path = e.file_path AND e.line BETWEEN u.start_line AND u.end_line GROUP BY 1",
        by_name="SELECT project_id, qualified_name, min(id) AS named FROM units GROUP BY ALL",
    )
)
def j8_finding_units(spark, sf_dir):
    units = load(spark, sf_dir, "units")
    n = load(spark, sf_dir, "part").count()
    own = units.filter("project_id = 'p1'").select("num", "file_path", F.col("qualified_name").alias("symbol"))
    e = load(spark, sf_dir, "events").withColumn("num", F.col("event_id") % n).join(own, "num")
    ext = e.select(F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("finding_id"), F.lit("p1").alias("project_id"), "file_path", (10 * F.col("num") + 10 + F.col("event_id") % 12).cast("int").alias("line"), "symbol")
    return fd.units_of(ext, units).select("finding_id", "unit_id")


_TRIAGE = """SELECT event_id, event_id % 10 <> 0 AS located, CAST(event_id % 4 AS INT) AS signals, CAST(user_id % 3 AS INT) AS callers, event_id % 7 = 0 AS entry_point, event_id % 6 = 0 AS protected, event_id % 11 = 0 AS suppressed,
CASE event_id % 5 WHEN 0 THEN 'FALSE_POSITIVE' WHEN 1 THEN 'TRUE_POSITIVE' WHEN 2 THEN 'FIXED' WHEN 3 THEN 'NEEDS_REVIEW' END AS feedback, event_id % 8 = 0 AS same_version FROM {events}"""


@query(
    f"""WITH t AS ({_TRIAGE.replace('{events}', 'events')}), b AS (SELECT *, (callers > 0 OR entry_point) AS r FROM t), v AS (SELECT *,
CASE WHEN NOT located THEN 'NEEDS_REVIEW' WHEN signals > 0 AND r AND protected THEN 'NEEDS_REVIEW' WHEN signals > 0 AND r THEN 'TRUE_RISK' WHEN signals = 0 AND NOT r THEN 'LIKELY_FALSE_POSITIVE' ELSE 'NEEDS_REVIEW' END AS v0,
CASE WHEN NOT located THEN 0.2 WHEN signals > 0 AND r AND protected THEN 0.75 WHEN signals > 0 AND r THEN least(0.9, 0.5 + 0.1 * signals + 0.05 * callers) WHEN signals = 0 AND NOT r THEN 0.6 ELSE 0.5 END AS c0 FROM b),
s AS (SELECT *, CASE WHEN suppressed THEN 'LIKELY_FALSE_POSITIVE' ELSE v0 END AS v1, CASE WHEN suppressed THEN greatest(c0, 0.9) ELSE c0 END AS c1 FROM v)
SELECT event_id, CASE WHEN same_version AND feedback = 'FALSE_POSITIVE' THEN 'LIKELY_FALSE_POSITIVE' WHEN same_version AND feedback = 'TRUE_POSITIVE' THEN 'TRUE_RISK' WHEN same_version AND feedback IS NOT NULL THEN 'NEEDS_REVIEW' ELSE v1 END AS verdict,
round(CAST(CASE WHEN same_version AND feedback = 'TRUE_POSITIVE' THEN greatest(c1, 0.95) WHEN same_version AND feedback IS NOT NULL THEN greatest(c1, 0.9) ELSE c1 END AS DOUBLE), 6) AS confidence FROM s"""
)
def f22_verdicts(spark, sf_dir):
    rows = spark.sql(_TRIAGE, events=load(spark, sf_dir, "events"))
    return fd.verdict(rows).select("event_id", "verdict", F.round("confidence", 6).alias("confidence"))


@query(duck("SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN status = 'CONFIRMED' THEN 'TRUE_RISK' WHEN status = 'DISMISSED' THEN 'LIKELY_FALSE_POSITIVE' ELSE 'NEEDS_REVIEW' END AS verdict FROM findings) GROUP BY 1"))
def a15_verdict_counts(spark, sf_dir):
    v = F.when(F.col("status") == "CONFIRMED", "TRUE_RISK").when(F.col("status") == "DISMISSED", "LIKELY_FALSE_POSITIVE").otherwise("NEEDS_REVIEW")
    return load(spark, sf_dir, "findings").groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


_FEEDBACK = "SELECT event_id, rule_id, fingerprint, CASE event_id % 5 WHEN 0 THEN 'FALSE_POSITIVE' WHEN 1 THEN 'TRUE_POSITIVE' WHEN 2 THEN 'FIXED' ELSE 'NEEDS_REVIEW' END AS status, found_at AS updated_at FROM {findings}"


@query(
    duck(
        "SELECT *, CASE WHEN confirmed + false_positive > 0 THEN confirmed / (confirmed + false_positive) END AS precision, CASE WHEN confirmed + false_positive > 0 THEN false_positive / (confirmed + false_positive) END AS false_rate, (confirmed + false_positive) / findings AS reviewed_rate FROM (SELECT rule_id, count(*) AS findings, count(*) FILTER (status IN ('TRUE_POSITIVE', 'FIXED')) AS confirmed, count(*) FILTER (status = 'FALSE_POSITIVE') AS false_positive FROM last_one GROUP BY rule_id)",
        fb=_FEEDBACK.replace("{findings}", "findings"),
        last_one="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, fingerprint ORDER BY updated_at DESC, event_id DESC) AS r FROM fb) WHERE r = 1",
    )
)
def a8_rule_evaluation(spark, sf_dir):
    return fd.evaluate_rules(spark.sql(_FEEDBACK, findings=load(spark, sf_dir, "findings")))


@query(duck("SELECT fingerprint, max_by(status, [CAST(epoch_us(found_at) AS BIGINT), event_id]) AS status FROM findings GROUP BY 1"))
def w2_latest_feedback(spark, sf_dir):
    return fd.latest(load(spark, sf_dir, "findings"), ["fingerprint"], F.desc("found_at"), F.desc("event_id")).select("fingerprint", "status")


@query(duck("SELECT fingerprint, min(event_id) AS event_id FROM findings GROUP BY 1"))
def w8_first_seen(spark, sf_dir):
    return fd.latest(load(spark, sf_dir, "findings"), ["fingerprint"], "event_id").select("fingerprint", "event_id")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events")
def w3_versions(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    return load(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("version"), F.lag("event_id").over(w).alias("previous"))


def _fold_sql(machine, actions: dict[str, str], start: str) -> str:
    case = " ".join(f"WHEN state = '{a}' AND action = '{act}' THEN '{b}'" for a, act, b in machine)
    named = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in actions.items())
    return (
        f"WITH RECURSIVE e AS (SELECT user_id, CASE event_type {named} END AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), "
        f"s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, '{start}' AS state, 0::BIGINT AS changes FROM e UNION ALL "
        f"SELECT s.user_id, s.i + 1, coalesce(CASE {case} END, state), changes + CASE WHEN (CASE {case} END) IS NULL THEN 0 ELSE 1 END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1) "
        "SELECT user_id, arg_max(state, i) AS state, max(changes) AS changes FROM s GROUP BY 1"
    )


def _fold(spark, sf_dir, machine, actions, start):
    e = load(spark, sf_dir, "events")
    named = F.element_at(F.create_map(*[F.lit(x) for kv in actions.items() for x in kv]), F.col("event_type"))
    return fd.fold(e.select("user_id", "ts", "event_id", named.alias("action")), "user_id", ["ts", "event_id"], "action", machine, start)


_REVIEW_ACTS = {"view": "claim", "click": "return", "purchase": "confirm", "error": "reject", "signup": "claim"}
_RULE_ACTS = {"view": "submit", "click": "publish", "purchase": "reject", "error": "reject", "signup": "submit"}
_TASK_ACTS = {"view": "start", "click": "succeed", "purchase": "partial", "error": "fail", "signup": "retry"}


@query(_fold_sql(fd.REVIEW, _REVIEW_ACTS, "PENDING"))
def d5_review_machine(spark, sf_dir):
    return _fold(spark, sf_dir, fd.REVIEW, _REVIEW_ACTS, "PENDING")


@query(_fold_sql(fd.RULES, _RULE_ACTS, "CANDIDATE"))
def d6_rule_machine(spark, sf_dir):
    return _fold(spark, sf_dir, fd.RULES, _RULE_ACTS, "CANDIDATE")


@query(_fold_sql(fd.TASKS, _TASK_ACTS, "QUEUED"))
def d7_task_machine(spark, sf_dir):
    return _fold(spark, sf_dir, fd.TASKS, _TASK_ACTS, "QUEUED")


@query(duck("SELECT id, coalesce(o.status, n.status) AS status, coalesce(n.found_at, o.found_at) AS found_at FROM (SELECT * FROM findings WHERE event_id % 3 <> 0) o FULL JOIN (SELECT id, 'SUSPECTED' AS status, found_at + INTERVAL 1 DAY AS found_at FROM findings WHERE event_id % 2 = 0) n USING (id)"))
def d3_upsert_findings(spark, sf_dir):
    f = load(spark, sf_dir, "findings")
    new = f.filter("event_id % 2 = 0").select("id", F.lit("SUSPECTED").alias("status"), (F.col("found_at") + F.expr("INTERVAL 1 DAY")).alias("found_at"))
    return fd.upsert(f.filter("event_id % 3 <> 0"), new)


@query(duck("SELECT fingerprint, min(found_at) AS first_seen, max(found_at) AS last_seen FROM findings GROUP BY 1"))
def d3_external_first_seen(spark, sf_dir):
    f = load(spark, sf_dir, "findings")
    old = f.filter("event_id % 2 = 0").groupBy("fingerprint").agg(F.min("found_at").alias("first_seen"), F.max("found_at").alias("last_seen"))
    return fd.merge_first_seen(old, f.filter("event_id % 2 = 1").select("fingerprint", F.col("found_at").alias("seen")))


@query("SELECT user_id AS batch, CASE WHEN bool_and(event_type IN ('view', 'click')) THEN 'SUCCEEDED' WHEN bool_or(event_type IN ('view', 'click', 'signup')) THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM events GROUP BY 1")
def a14_batch_status(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    s = F.when(F.col("event_type").isin("view", "click"), "SUCCEEDED").when(F.col("event_type") == "signup", "PARTIAL").otherwise("FAILED")
    return fd.batch_status(events.select(F.col("user_id").alias("batch"), s.alias("status")))


@query(
    duck(
        "SELECT f.id AS id, (SELECT max_by(s.id, [s.created, s.id]) FROM sup s WHERE s.rule_id = f.rule_id AND s.project_id = f.project_id AND s.active AND s.expires > 10 AND (s.scope = 'PROJECT' OR regexp_full_match(u.file_path, s.pattern))) AS suppression_id FROM findings f JOIN units u ON f.unit_id = u.id",
        sup="SELECT * FROM (VALUES ('s1', 'p1', 'SQL_INJECTION', 'PATH', 'src/asia/[^/]*', 'a', 20, true), ('s2', 'p1', 'SQL_INJECTION', 'PROJECT', '', 'b', 5, true), ('s3', 'p1', 'WEAK_CRYPTO', 'PROJECT', '', 'c', 20, true), ('s4', 'p1', 'WEAK_CRYPTO', 'PATH', 'src/.*', 'd', 20, true), ('s5', 'p2', 'PATH_TRAVERSAL', 'PROJECT', '', 'e', 20, false)) t(id, project_id, rule_id, scope, pattern, created, expires, active)",
    )
)
def d9_suppressions(spark, sf_dir):
    rows = [("s1", "p1", "SQL_INJECTION", "PATH", "src/asia/*", 1, 20, True), ("s2", "p1", "SQL_INJECTION", "PROJECT", "", 2, 5, True), ("s3", "p1", "WEAK_CRYPTO", "PROJECT", "", 3, 20, True), ("s4", "p1", "WEAK_CRYPTO", "PATH", "src/**", 4, 20, True), ("s5", "p2", "PATH_TRAVERSAL", "PROJECT", "", 5, 20, False)]
    sup = spark.createDataFrame(rows, "id string, project_id string, rule_id string, scope string, scope_value string, c long, e long, active boolean")
    sup = sup.withColumns({"created_at": F.timestamp_seconds("c"), "expires_at": F.timestamp_seconds("e")})
    f = load(spark, sf_dir, "findings").join(load(spark, sf_dir, "units").select(F.col("id").alias("unit_id"), "file_path"), "unit_id").withColumnRenamed("id", "finding_id")
    return fd.active_suppressions(f, sup, "1970-01-01 00:00:10").select(F.col("finding_id").alias("id"), "suppression_id")


@query("SELECT 'changed' AS kind, CAST(p_partkey AS VARCHAR) AS file_path FROM part WHERE p_partkey % 4 <> 0 AND (p_partkey % 5 = 0 OR p_partkey % 7 = 0) UNION ALL SELECT 'deleted', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 7 <> 0")
def j12_changed_files(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("file_path"))
    current = p.filter("p_partkey % 4 <> 0").select("file_path", F.md5(F.concat("file_path", F.when(F.col("p_partkey") % 5 == 0, "new").otherwise("old"))).alias("hash"))
    cached = p.filter("p_partkey % 7 <> 0").select("file_path", F.md5(F.concat("file_path", F.lit("old"))).alias("hash"))
    changed, deleted = fd.changed_files(current, cached)
    return changed.select(F.lit("changed").alias("kind"), "file_path").unionByName(deleted.select(F.lit("deleted").alias("kind"), "file_path"))


@query(
    "WITH g AS (SELECT user_id % 5 AS project_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id % 5 ORDER BY ts) < INTERVAL 3 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY project_id ORDER BY ts) AS burst FROM g)"
    " SELECT project_id, min(ts) AS first, max(ts) AS last, count(*) AS changes FROM s GROUP BY project_id, burst"
)
def s213_change_bursts(spark, sf_dir):
    return bursts(load(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("project_id"), "ts"), "3 minutes")


#: Sinks that the summaries of parts come to, by a fifth of the part's number; the last has no rule.
_SINKS = ("executeQuery", "lookup", "exec", "print", "sendRedirect", "parse", "search", "invoke", "mystery")
_SUMMARY = f"""SELECT 'm' || CAST(p_partkey AS STRING) AS method, CAST(0 AS INT) AS from_param, CASE WHEN p_partkey % 5 = 0 THEN 'SINK' WHEN p_partkey % 7 = 0 THEN 'RETURN' ELSE 'CALL_ARG' END AS kind,
CASE WHEN p_partkey % 5 <> 0 THEN 'run' {' '.join(f"WHEN CAST(floor(p_partkey / 5) AS INT) % {len(_SINKS)} = {k} THEN '{x}'" for k, x in enumerate(_SINKS))} END AS callee, CAST(0 AS INT) AS to_index FROM {{part}}"""


def _queue(start: str, hop: str, depth: int, limit: int) -> dict[str, str]:
    """Parts of SQL for a search from each entry, a level a part: first come first served in the order of paths, ``limit`` nodes an entry.

    ``start`` gives (entry, id, path), ``hop`` (id, next, mark); s<depth> has all nodes (entry, id, path, d) in the end.
    """
    parts = {"hop": hop, "l0": start, "s0": "SELECT entry, id, path, 0 AS d FROM l0"}
    for d in range(1, depth + 1):
        parts[f"c{d}"] = f"SELECT entry, next AS id, min(list_append(path, mark)) AS path FROM l{d - 1} JOIN hop USING (id) GROUP BY ALL"
        parts[f"n{d}"] = f"SELECT c{d}.* FROM c{d} ANTI JOIN s{d - 1} USING (entry, id)"
        parts[f"l{d}"] = f"SELECT entry, id, path FROM (SELECT n{d}.*, have + row_number() OVER (PARTITION BY entry ORDER BY path) AS r FROM n{d} JOIN (SELECT entry, count(*) AS have FROM s{d - 1} GROUP BY 1) USING (entry)) WHERE r <= {limit}"
        parts[f"s{d}"] = f"SELECT * FROM s{d - 1} UNION ALL SELECT entry, id, path, {d} FROM l{d}"
    return parts


_TAINT = {
    "summary": _SUMMARY.replace("{part}", "part"),
    **_queue(
        "SELECT id AS entry, id, [id || ':0'] AS path FROM units WHERE is_entry_point",
        "SELECT DISTINCT src AS id, dst AS next, dst || ':0' AS mark FROM edges JOIN summary ON src = method WHERE edges.kind = 'CALLS' AND summary.kind = 'CALL_ARG'",
        6, flow.MAX_METHODS,
    ),
    "ends": "SELECT entry, summary.kind AS end_kind, CASE WHEN summary.kind = 'SINK' THEN callee END AS sink, d + 1 AS depth, path FROM s6 JOIN summary ON id = method WHERE summary.kind <> 'CALL_ARG'",
    "first": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY depth, path, end_kind, coalesce(sink, '')) AS r, count(*) OVER (PARTITION BY entry) AS every FROM ends) WHERE r <= {flow.MAX_PATHS}",
}


@query(duck("SELECT entry, end_kind, coalesce(sink, '') AS sink, depth, count(*) AS paths FROM first GROUP BY ALL", **_TAINT))
def x6_taint_paths(spark, sf_dir):
    return _taint(spark, sf_dir)[0].groupBy("entry", F.col("end").alias("end_kind"), F.coalesce("sink", F.lit("")).alias("sink"), "depth").agg(F.count("*").alias("paths"))


@query(
    duck(
        f"SELECT entry, count(*) AS methods, count(*) > {flow.MAX_METHODS - 1} AND (SELECT count(*) FROM over_ o WHERE o.entry = s6.entry) > 0 OR bool_or(d = 6 AND id IN (SELECT id FROM hands_on)) OR (SELECT count(*) FROM ends e WHERE e.entry = s6.entry) > {flow.MAX_PATHS} AS truncated FROM s6 GROUP BY entry",
        **_TAINT,
        hands_on="SELECT method AS id FROM summary WHERE kind = 'CALL_ARG'",
        over_=" UNION ALL ".join(f"SELECT entry FROM n{d} ANTI JOIN l{d} USING (entry, id)" for d in range(1, 7)),
    )
)
def x6_taint_runs(spark, sf_dir):
    return _taint(spark, sf_dir)[1].select("entry", "methods", "truncated")


def _taint(spark, sf_dir):
    units, edges = load(spark, sf_dir, "units"), load(spark, sf_dir, "edges")
    summaries = spark.sql(_SUMMARY, part=load(spark, sf_dir, "part"))
    calls = edges.filter("kind = 'CALLS'").select(F.col("src").alias("method"), F.col("dst").alias("callee_method"), F.lit("run").alias("callee_name")).distinct()
    entries = units.filter("is_entry_point").select(F.col("id").alias("entry"), F.lit(0).alias("param"))
    return flow.taint(summaries, calls, entries)


#: The rules of the sinks above, written out.
_RULES = """(VALUES ('executeQuery', 'SQL_INJECTION_TAINT', 'CWE-89', 'HIGH'), ('lookup', 'JNDI_INJECTION_TAINT', 'CWE-917', 'CRITICAL'), ('exec', 'COMMAND_INJECTION_TAINT', 'CWE-78', 'HIGH'), ('print', 'XSS_TAINT', 'CWE-79', 'MEDIUM'),
('sendRedirect', 'OPEN_REDIRECT_TAINT', 'CWE-601', 'MEDIUM'), ('parse', 'XXE_TAINT', 'CWE-611', 'HIGH'), ('search', 'LDAP_INJECTION_TAINT', 'CWE-90', 'HIGH'), ('invoke', 'UNSAFE_REFLECTION_TAINT', 'CWE-470', 'HIGH'), ('mystery', 'TAINT_SINK', 'CWE-XX', 'HIGH')) rules(sink, rule_id, cwe, severity)"""


@query(duck(f"SELECT entry, sink, min(depth) AS depth, rule_id, cwe, severity, substr(sha256('p1:' || rule_id || ':' || entry || ':0:' || sink), 1, 16) AS finding_id FROM first JOIN {_RULES} USING (sink) WHERE end_kind = 'SINK' GROUP BY ALL", **_TAINT))
def x7_taint_scan(spark, sf_dir):
    return flow.taint_findings(_taint(spark, sf_dir)[0], "p1").select("entry", "sink", "depth", "rule_id", "cwe", "severity", "finding_id")


_ROUTES = _queue("SELECT id AS entry, id, [id] AS path FROM units WHERE is_entry_point", "SELECT DISTINCT src AS id, dst AS next, dst AS mark FROM edges WHERE kind = 'CALLS'", flow.MAX_DEPTH, flow.MAX_METHODS)


@query(duck(f"SELECT entry AS root, id, d AS depth FROM s{flow.MAX_DEPTH}", **_ROUTES))
def g6_routes(spark, sf_dir):
    units, edges = load(spark, sf_dir, "units"), load(spark, sf_dir, "edges")
    return flow.routes(edges, units.filter("is_entry_point").select("id")).select("root", "id", "depth")


@query(
    duck(
        f"SELECT entry AS root, r.kind AS kind, target, qualified_name AS method, min(d) AS depth FROM s{flow.MAX_DEPTH} s JOIN units u ON s.id = u.id JOIN (VALUES ('DATABASE', 'executeQuery', 'executeQuery('), ('DANGEROUS_SINK', 'Runtime.exec', 'Runtime.getRuntime().exec(')) r(kind, target, mark) ON contains(u.raw_source, r.mark) GROUP BY ALL",
        **_ROUTES,
    )
)
def x9_resource_accesses(spark, sf_dir):
    units, edges = load(spark, sf_dir, "units"), load(spark, sf_dir, "edges")
    found = flow.routes(edges, units.filter("is_entry_point").select("id"))
    return flow.resource_accesses(found, units).select("root", "kind", "target", "method", "depth")


@query(duck("SELECT u.id, CAST(count(e.src) AS BIGINT) AS callers, count(e.src) > 0 OR u.is_entry_point AS reachable FROM units u LEFT JOIN (SELECT DISTINCT src, dst FROM edges WHERE kind = 'CALLS') e ON e.dst = u.id WHERE u.num IS NOT NULL GROUP BY u.id, u.is_entry_point"))
def g5_reachable(spark, sf_dir):
    units, edges = load(spark, sf_dir, "units").filter("num IS NOT NULL"), load(spark, sf_dir, "edges")
    n = edges.filter("kind = 'CALLS'").select("src", "dst").distinct().groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    both = units.join(n, "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    return both.select("id", "callers", ((F.col("callers") > 0) | F.col("is_entry_point")).alias("reachable"))


_DOC = "'/**\n * Runs ' || id || ' once. More.\n * @return x\n */ '"


@query(
    duck(
        "SELECT u.id, CASE WHEN u.kind = 'DOCUMENT' THEN substr(u.source, 1, 1024) ELSE trim(CASE WHEN c.id IS NOT NULL THEN CASE WHEN c.annotations <> '' THEN replace(c.annotations, ',', ' ') || ' ' ELSE '' END || c.signature || ' ' ELSE '' END"
        " || CASE WHEN u.num % 2 = 0 THEN 'Runs ' || u.id || ' once.. ' ELSE '' END || CASE WHEN u.annotations <> '' THEN replace(u.annotations, ',', ' ') || ' ' ELSE '' END || u.signature) END AS semantic_text FROM own u LEFT JOIN units c ON c.kind = 'CLASS' AND u.kind <> 'CLASS' AND c.project_id = u.project_id AND c.qualified_name = u.parent_qualified_name",
        own=f"SELECT * EXCLUDE (kind), CASE WHEN num % 10 = 9 THEN 'DOCUMENT' ELSE kind END AS kind, CASE WHEN num % 10 = 9 THEN repeat('text ', 300) WHEN num % 2 = 0 THEN {_DOC.replace(chr(92) + 'n', chr(10))} || raw_source ELSE raw_source END AS source FROM units",
    )
)
def p12_semantic_text(spark, sf_dir):
    units, n = load(spark, sf_dir, "units"), F.col("num")
    doc = F.concat(F.lit("/**\n * Runs "), "id", F.lit(" once. More.\n * @return x\n */ "), "raw_source")
    own = units.withColumn("raw_source", F.when(n % 10 == 9, F.lit("text " * 300)).when(n % 2 == 0, doc).otherwise(F.col("raw_source"))).withColumn("kind", F.when(n % 10 == 9, "DOCUMENT").otherwise(F.col("kind")))
    return retrieval.semantic_text(own)


@query(duck("SELECT sha256(project_id || file_path || kind || qualified_name) AS unit_id, substr(sha256(file_path), 1, 12) AS project_key, md5(raw_source) AS file_key, id FROM units"))
def ids_of_units(spark, sf_dir):
    return load(spark, sf_dir, "units").select(F.sha2(F.concat("project_id", "file_path", "kind", "qualified_name"), 256).alias("unit_id"), F.substring(F.sha2("file_path", 256), 1, 12).alias("project_key"), F.md5("raw_source").alias("file_key"), "id")
