"""Findings: context, triage verdicts, upserts, evaluation of rules, state machines, lists and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.code import glob_pattern, version_key  # noqa: F401

SEVERITY_ORDER = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")

#: Texts that hint at protection against a weakness, in lower case.
PROTECTIONS = {
    "CWE-78": (".matches(", "pattern.matches(", "allowlist", "whitelist", "validatecommand"),
    "CWE-89": ("preparedstatement", "preparestatement(", "namedparameterjdbctemplate"),
    "CWE-79": ("htmlutils.htmlescape", "stringescapeutils.escapehtml", "encodeforhtml", "jsoup.clean"),
    "CWE-22": ("getcanonicalpath(", ".torealpath(", ".normalize(", "startswith("),
    "CWE-502": ("objectinputfilter", "setobjectinputfilter(", "serialfilter"),
}

#: State machines as (from, action, to); what isn't listed changes nothing.
REVIEW = [("PENDING", "claim", "IN_REVIEW"), ("IN_REVIEW", "return", "PENDING"), ("IN_REVIEW", "confirm", "CONFIRMED"), ("IN_REVIEW", "reject", "REJECTED")]
RULES = [("CANDIDATE", "submit", "IN_REVIEW"), ("IN_REVIEW", "publish", "PUBLISHED"), ("IN_REVIEW", "reject", "REJECTED"), ("CANDIDATE", "reject", "REJECTED")]
TASKS = [
    ("QUEUED", "start", "RUNNING"), ("QUEUED", "cancel", "CANCELLED"), ("RUNNING", "cancel", "CANCELLED"), ("RUNNING", "succeed", "SUCCEEDED"), ("RUNNING", "partial", "PARTIAL"),
    ("RUNNING", "fail", "FAILED"), ("FAILED", "retry", "QUEUED"), ("PARTIAL", "retry", "QUEUED"),
]


def severity_rank(severity: Column) -> Column:
    out = F.lit(len(SEVERITY_ORDER))
    for i, s in enumerate(SEVERITY_ORDER):
        out = F.when(F.upper(severity) == s, i).otherwise(out)
    return out


def list_findings(findings: DataFrame, project_id: str, severity: str | None = None, status: str | None = None) -> DataFrame:
    own = findings.filter(F.col("project_id") == project_id)
    for name, value in (("severity", severity), ("status", status)):
        if value:
            own = own.filter(F.col(name) == value.upper())
    return own.orderBy(severity_rank(F.col("severity")), F.desc("found_at"), "id")


def report(findings: DataFrame) -> DataFrame:
    """(bucket, key, n) by severity, status and CWE and in total, in one pass."""
    rows = findings.select(F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), k.alias("key")) for b, k in (("total", F.lit("all")), ("severity", F.col("severity")), ("status", F.col("status")), ("cwe", F.col("cwe")))])).alias("x"))
    return rows.select("x.*").groupBy("bucket", "key").agg(F.count("*").alias("n"))


def page(df: DataFrame, number: int, size: int, *order) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows, both clamped."""
    size = max(1, min(size, 200))
    return df.orderBy(*order).offset(max(0, number) * size).limit(size)


def reviews(entries: DataFrame, project_id: str, severity: str | None = None, verdict: str | None = None, status: str | None = None, rule_id: str | None = None, updated_after: str | None = None, updated_before: str | None = None) -> DataFrame:
    """Review entries of a project that fit all given conditions, the last changed first; the time is from ``updated_after`` up to, without, ``updated_before``."""
    own = entries.filter(F.col("project_id") == project_id)
    for name, value in (("severity", severity), ("verdict", verdict), ("status", status), ("rule_id", rule_id)):
        if value and value.strip():
            own = own.filter(F.col(name) == value)
    if updated_after:
        own = own.filter(F.col("updated_at") >= updated_after)
    if updated_before:
        own = own.filter(F.col("updated_at") < updated_before)
    return own.orderBy(F.desc("updated_at"), "id")


def page_and_more(df: DataFrame, number: int, size: int, *order) -> DataFrame:
    """A page as ``page`` gives it, each row with whether another page follows."""
    size = max(1, min(size, 200))
    rows = df.orderBy(*order).offset(max(0, number) * size).limit(size + 1)
    place = F.row_number().over(Window.orderBy(*order))  # a page of rows
    return rows.withColumn("_r", place).withColumn("has_more", F.max("_r").over(Window.partitionBy()) > size).filter(F.col("_r") <= size).drop("_r")


def review_contexts(findings: DataFrame, feedback: DataFrame, suppressions: DataFrame, snapshots: DataFrame, now: str) -> DataFrame:
    """Findings (finding_id, project_id, rule_id, fingerprint, file_path) with the feedback (project_id, fingerprint, status,
    updated_at) that is newest, the suppression that is in force, and the report (fingerprint, report, created_at) that was first."""
    said = feedback.groupBy("project_id", "fingerprint").agg(F.max_by("status", F.struct("updated_at", "status")).alias("feedback"))
    first = snapshots.groupBy("fingerprint").agg(F.min_by("report", F.struct("created_at", "report")).alias("report"))
    return active_suppressions(findings, suppressions, now).join(said, ["project_id", "fingerprint"], "left").join(first, "fingerprint", "left")


def units_of(findings: DataFrame, units: DataFrame) -> DataFrame:
    """Findings with the unit at their line (the shortest, then the least id), else the one with their symbol as name.

    A unit stands in the one or two cells of its file that are as wide as the power of two above its length, and a finding
    looks into the cell of its line at each width that occurs: so it meets units about its line alone, however many its file has.
    """
    length = F.col("end_line").cast("long") - F.col("start_line")
    spans = units.filter("start_line <= end_line").groupBy("project_id", "file_path", "start_line", "end_line").agg(F.min("id").alias("at_unit")).withColumn("width", F.char_length(F.bin(length)))
    widths = [r[0] for r in units.filter("start_line <= end_line").select(F.char_length(F.bin(length)).alias("width")).distinct().collect()]
    cell = lambda c: F.expr(f"shiftright(CAST({c} AS BIGINT), width)")
    cells = spans.withColumn("cell", F.explode(F.array_distinct(F.array(cell("start_line"), cell("end_line")))))
    asked = findings.select("finding_id", "project_id", "file_path", "line", F.explode(F.array(*map(F.lit, widths)).cast("array<int>")).alias("width")).withColumn("cell", cell("line"))
    at = asked.join(cells, ["project_id", "file_path", "width", "cell"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    located = at.groupBy("finding_id").agg(F.min_by("at_unit", F.struct(F.col("end_line") - F.col("start_line"), "at_unit")).alias("at_unit"))
    named = units.groupBy("project_id", F.col("qualified_name").alias("symbol")).agg(F.min("id").alias("by_name"))
    return findings.join(located, "finding_id", "left").join(named, ["project_id", "symbol"], "left").withColumn("unit_id", F.coalesce("at_unit", "by_name")).drop("at_unit", "by_name")


def verdict(rows: DataFrame) -> DataFrame:
    """verdict and confidence from located, signals, callers, entry_point, protected, suppressed, feedback and same_version."""
    reachable = (F.col("callers") > 0) | F.col("entry_point")
    marked = F.col("signals") > 0
    risk = F.least(F.lit(0.9), 0.5 + 0.1 * F.col("signals") + 0.05 * F.col("callers"))
    cases = [
        (~F.col("located"), "NEEDS_REVIEW", F.lit(0.2)),
        (marked & reachable & F.col("protected"), "NEEDS_REVIEW", F.lit(0.75)),
        (marked & reachable, "TRUE_RISK", risk),
        (~marked & ~reachable, "LIKELY_FALSE_POSITIVE", F.lit(0.6)),
    ]
    v, c = F.lit("NEEDS_REVIEW"), F.lit(0.5)
    for when, name, sure in reversed(cases):
        v, c = F.when(when, name).otherwise(v), F.when(when, sure).otherwise(c)
    c = F.when(F.col("suppressed"), F.greatest(c, F.lit(0.9))).otherwise(c)
    v = F.when(F.col("suppressed"), "LIKELY_FALSE_POSITIVE").otherwise(v)
    said = F.when(F.col("same_version"), F.col("feedback"))
    c = F.when(said == "TRUE_POSITIVE", F.greatest(c, F.lit(0.95))).when(said.isNotNull(), F.greatest(c, F.lit(0.9))).otherwise(c)
    v = F.when(said == "FALSE_POSITIVE", "LIKELY_FALSE_POSITIVE").when(said == "TRUE_POSITIVE", "TRUE_RISK").when(said.isNotNull(), "NEEDS_REVIEW").otherwise(v)
    return rows.withColumns({"verdict": v, "confidence": c})


def protections(evidence: DataFrame) -> DataFrame:
    """Evidence (finding_id, cwe, source, relation, excerpt, file_path, start_line, end_line, qualified_name, trace) with hints of
    protection, and whether a guarding step of the trace in it lies after all sources and before all sinks."""
    low, steps = F.lower("excerpt"), F.col("trace")
    hint = F.lit(False)
    for weakness, marks in PROTECTIONS.items():
        some = F.lit(False)
        for m in marks:
            some = some | low.contains(m)
        hint = hint | ((F.col("cwe") == weakness) & some)
    scope = (F.col("source") == "FINDING") | (F.col("relation") == "CALLEE")
    at = F.transform(steps, lambda s, i: F.struct(F.lower(s["kind"]).alias("kind"), i.alias("i"), s["file_path"].alias("f"), s["start_line"].alias("line"), F.lower(s["symbol"]).alias("symbol")))
    last = F.array_max(F.transform(F.filter(at, lambda s: s["kind"] == "source"), lambda s: s["i"]))
    first = F.array_min(F.transform(F.filter(at, lambda s: s["kind"] == "sink"), lambda s: s["i"]))
    here = lambda s: (s["f"] == F.col("file_path")) & (((s["line"] > 0) & s["line"].between(F.col("start_line"), F.col("end_line"))) | ((F.trim(s["symbol"]) != "") & F.lower("qualified_name").contains(s["symbol"])))
    aligned = F.exists(at, lambda s: s["kind"].isin("sanitizer", "validation", "guard", "barrier") & here(s) & (s["i"] > last) & (s["i"] < first))
    return evidence.filter(scope & hint).withColumn("aligned", F.coalesce(aligned, F.lit(False)))


def active_suppressions(findings: DataFrame, suppressions: DataFrame, now: str) -> DataFrame:
    """Findings with the newest suppression that is active, not expired and fits project, rule and path."""
    live = suppressions.filter(F.col("active") & (F.col("expires_at") > F.lit(now).cast("timestamp"))).select(F.col("id").alias("suppression_id"), "project_id", "rule_id", "scope", "scope_value", "created_at", glob_pattern(F.col("scope_value")).alias("pattern"))
    fits = (F.col("scope") == "PROJECT") | F.rlike("file_path", F.col("pattern"))
    hit = findings.join(live, ["project_id", "rule_id"]).filter(fits).groupBy("finding_id").agg(F.max_by("suppression_id", F.struct("created_at", "suppression_id")).alias("suppression_id"))
    return findings.join(hit, "finding_id", "left")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings after a scan: known ones keep their status and take the new time, others are added as found."""
    fresh = new.select("id", F.col("status").alias("n_status"), F.col("found_at").alias("n_found"))
    both = old.select("id", "status", "found_at").join(fresh, "id", "full")
    return both.select("id", F.coalesce("status", "n_status").alias("status"), F.coalesce("n_found", "found_at").alias("found_at"))


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row of each key, first by ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def evaluate_rules(feedback: DataFrame) -> DataFrame:
    """Per rule: distinct fingerprints, confirmed and false ones by their latest status, and rates (null without reviewed ones)."""
    last = latest(feedback, ["rule_id", "fingerprint"], F.desc("updated_at"), F.desc("event_id"))
    confirmed, false = F.count_if(F.col("status").isin("TRUE_POSITIVE", "FIXED")), F.count_if(F.col("status") == "FALSE_POSITIVE")
    sums = last.groupBy("rule_id").agg(F.count("*").alias("findings"), confirmed.alias("confirmed"), false.alias("false_positive"))
    known = F.col("confirmed") + F.col("false_positive")
    return sums.withColumns({"precision": F.try_divide("confirmed", known), "false_rate": F.try_divide("false_positive", known), "reviewed_rate": F.try_divide(known, "findings")})


#: Events of a key that are folded at once.
BLOCK_EVENTS = 1000
#: States of a finding.
STATUSES = ("SUSPECTED", "CONFIRMED", "FIXED", "DISMISSED")


def _next(state: Column, action: Column, transitions: list[tuple[str, str, str]]) -> Column:
    to = F.lit(None).cast("string")
    for a, act, b in transitions:
        to = F.when((state == a) & (action == act), b).otherwise(to)
    return to


def _blocks(events: DataFrame, key: str, order: list[str], *columns: Column) -> DataFrame:
    """(key, block, e): the events of a key in order, cut into blocks of at most ``BLOCK_EVENTS``."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    rows = events.withColumn("place", place).withColumn("block", F.floor(F.col("place") / BLOCK_EVENTS))
    return rows.groupBy(key, "block").agg(F.sort_array(F.collect_list(F.struct("place", *columns))).alias("e"))


def _through(blocks: DataFrame, key: str, transitions: list[tuple[str, str, str]], start: str) -> DataFrame:
    """(key, t): for each block of a key, in order, where each state leads to through it, and after how many changes."""
    states = sorted({start, *(a for a, _, _ in transitions), *(b for _, _, b in transitions)})

    def led(state: str) -> Column:
        def step(acc: Column, e: Column) -> Column:
            to = _next(acc["state"], e["action"], transitions)
            return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["changes"] + F.when(to.isNotNull(), 1).otherwise(0)).alias("changes"))

        return F.aggregate("e", F.struct(F.lit(state).alias("state"), F.lit(0).alias("changes")), step)

    table = F.create_map(*[x for s in states for x in (F.lit(s), led(s))])
    return blocks.select(key, "block", table.alias("to")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("block", F.map_entries("to").alias("to")))).alias("t"))


def _entry(block: Column, state: Column) -> Column:
    """Where ``state`` leads to through a block."""
    return F.filter(block["to"], lambda x: x["key"] == state)[0]["value"]


def fold(events: DataFrame, key: str, order: list[str], action: str, transitions: list[tuple[str, str, str]], start: str) -> DataFrame:
    """(key, state, changes): actions applied in order to each key's state; one that doesn't fit the state is ignored.

    A block of events becomes a table from state to state, and these tables apply one after another: a key of many events
    is never held whole.
    """
    tables = _through(_blocks(events, key, order, F.col(action).alias("action")), key, transitions, start)
    step = lambda acc, t: F.struct(_entry(t, acc["state"])["state"].alias("state"), (acc["changes"] + _entry(t, acc["state"])["changes"]).alias("changes"))
    return tables.select(key, F.aggregate("t", F.struct(F.lit(start).alias("state"), F.lit(0).alias("changes")), step).alias("s")).select(key, "s.state", F.col("s.changes").cast("long").alias("changes"))


def audit(events: DataFrame, key: str, order: list[str], action: str, transitions: list[tuple[str, str, str]], start: str, expected: str | None = None) -> DataFrame:
    """(key, place, action, before, after, actor): a row for each action that changed the state, by its place among the key's events.

    ``events`` has a column actor.  With ``expected``, an action applies only if that column is null or names the state at the moment.
    """
    own = events if expected is None else events.withColumn("_expected", F.col(expected))
    want = F.lit(None).cast("string") if expected is None else F.col("_expected")
    # the expectation becomes part of the action, so that the tables of states still tell where a block leads
    wanted = F.when(want.isNull(), F.col(action)).otherwise(F.concat_ws("@", action, want))
    every = [*transitions, *([(a, f"{act}@{a}", b) for a, act, b in transitions] if expected else [])]
    blocks = _blocks(own, key, order, wanted.alias("action"), "actor")
    tables = _through(blocks, key, every, start)
    first = F.struct(F.lit(start).alias("state"), F.array().cast("array<struct<block: bigint, state: string>>").alias("at"))
    opened = F.aggregate("t", first, lambda acc, t: F.struct(_entry(t, acc["state"])["state"].alias("state"), F.concat(acc["at"], F.array(F.struct(t["block"].alias("block"), acc["state"].alias("state")))).alias("at")))
    starts = tables.select(key, F.explode(opened["at"]).alias("o")).select(key, "o.block", F.col("o.state").alias("_start"))

    def step(acc: Column, e: Column) -> Column:
        to = _next(acc["state"], e["action"], every)
        row = F.struct(e["place"].alias("place"), F.substring_index(e["action"], "@", 1).alias("action"), acc["state"].alias("before"), to.alias("after"), e["actor"].alias("actor"))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), F.when(to.isNull(), acc["rows"]).otherwise(F.concat(acc["rows"], F.array(row))).alias("rows"))

    kinds = dict(events.dtypes)
    none = F.array().cast(f"array<struct<place: int, action: string, before: string, after: string, actor: {kinds['actor']}>>")
    done = blocks.join(starts, [key, "block"]).select(key, F.aggregate("e", F.struct(F.col("_start").alias("state"), none.alias("rows")), step)["rows"].alias("rows"))
    return done.select(key, F.explode("rows").alias("r")).select(key, F.col("r.place").cast("long").alias("place"), "r.action", "r.before", "r.after", "r.actor")


def claims(changes: DataFrame, key: str) -> DataFrame:
    """(key, state, claimed_by) after the changes of ``audit`` over ``REVIEW``: a claim has its actor, a return has none."""
    last = changes.groupBy(key).agg(F.max_by(F.struct("after", "action", "actor"), "place").alias("x"), F.max_by("actor", F.when(F.col("action") == "claim", F.col("place"))).alias("claimer"))
    return last.select(key, F.col("x.after").alias("state"), F.when(F.col("x.after") != "PENDING", F.col("claimer")).alias("claimed_by"))


def set_status(findings: DataFrame, updates: DataFrame) -> DataFrame:
    """Findings (id, status, ...) with the newest valid status of updates (id, status, updated_at); any may follow any."""
    valid = updates.withColumn("status", F.upper("status")).filter(F.col("status").isin(*STATUSES))
    newest = valid.groupBy("id").agg(F.max_by("status", F.struct("updated_at", "status")).alias("_new"))
    return findings.join(newest, "id", "left").withColumn("status", F.coalesce("_new", "status")).select(*findings.columns)


def published(actions: DataFrame) -> DataFrame:
    """(rule_id, version, status) of rule versions after actions (rule_id, seq, action, version, gate_ok) in order.

    A candidate is submitted, then published if its gate holds, which supersedes the version that was active, or
    rejected; a rollback takes the active version back and the one published before it is active again.  The rules of a
    partition go through one reader in order, one rule's versions at a time.
    """

    kind = dict(actions.dtypes)["rule_id"]
    ordered = actions.select("rule_id", "seq", "action", F.col("version").cast("long").alias("version"), "gate_ok").repartition("rule_id").sortWithinPartitions("rule_id", "seq")

    def run(batches):
        import pyarrow as pa

        at, of, status, line, out = None, None, {}, [], []  # line: the published versions, the active one last

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], of), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], ["rule_id", "version", "status"])

        for batch in batches:
            of = batch.schema.field(0).type
            for rule, _, action, version, gate_ok in zip(*(c.to_pylist() for c in batch.columns)):
                if rule != at:
                    out += [(at, v, s) for v, s in status.items()]
                    at, status, line = rule, {}, []
                now = status.setdefault(version, "CANDIDATE") if action != "rollback" else None
                if action == "submit" and now == "CANDIDATE":
                    status[version] = "IN_REVIEW"
                elif action == "reject" and now in ("CANDIDATE", "IN_REVIEW"):
                    status[version] = "REJECTED"
                elif action == "publish" and now == "IN_REVIEW" and gate_ok:
                    if line:
                        status[line[-1]] = "SUPERSEDED"
                    line.append(version)
                    status[version] = "PUBLISHED"
                elif action == "rollback" and len(line) > 1:
                    status[line.pop()] = "ROLLED_BACK"
                    status[line[-1]] = "PUBLISHED"
            if out:
                yield packed()
                out.clear()
        out += [(at, v, s) for v, s in status.items()]
        if out:
            yield packed()

    return ordered.mapInArrow(run, f"rule_id {kind}, version long, status string")


def retried(runs: DataFrame) -> DataFrame:
    """(task_id, scanner) that a retry runs again: of tasks that failed or are partial, the scanners whose last run (task_id, scanner, seq, status) did not succeed."""
    last = runs.groupBy("task_id", "scanner").agg(F.max_by("status", "seq").alias("status"))
    open_ = batch_status(last.withColumnRenamed("task_id", "batch")).filter("status <> 'SUCCEEDED'").select(F.col("batch").alias("task_id"))
    return last.filter("status <> 'SUCCEEDED'").join(open_, "task_id", "left_semi").select("task_id", "scanner")


def after_retry(runs: DataFrame, again: DataFrame) -> DataFrame:
    """The runs that stand after a retry: the successful last ones of before, and those of the retry (same columns)."""
    last = runs.withColumn("_r", F.row_number().over(Window.partitionBy("task_id", "scanner").orderBy(F.desc("seq")))).filter("_r = 1").drop("_r")
    return last.filter("status = 'SUCCEEDED'").join(again.select("task_id", "scanner"), ["task_id", "scanner"], "left_anti").select(*runs.columns).unionByName(again.select(*runs.columns))


#: Tasks that may run at once in all, of a project, of a scanner.
QUOTAS = (4, 2, 2)


def started(queue: DataFrame, running: DataFrame, quotas: tuple[int, int, int] = QUOTAS) -> DataFrame:
    """(task_id, project_id, scanner) of queued tasks (and seq) that may start beside the running ones, first come first
    served; one that has no place is passed over.  A step a place: no more than the first quota."""
    names = ["task_id", "project_id", "scanner"]
    spark, going = queue.sparkSession, [tuple(r) for r in running.select(*names).limit(quotas[0] + 1).collect()]
    new: list[tuple] = []
    while len(going) < quotas[0]:
        full = [[x for x in {r[k] for r in going} if sum(r[k] == x for r in going) >= quotas[k]] for k in (1, 2)]
        open_ = queue.filter(~F.col("task_id").isin(*[r[0] for r in going] or [None]) if going else F.lit(True))
        for c, taken in (("project_id", full[0]), ("scanner", full[1])):
            open_ = open_.filter(~F.col(c).isin(*taken)) if taken else open_
        first = open_.orderBy("seq", "task_id").select(*names).limit(1).collect()
        if not first:
            break
        new.append(tuple(first[0]))
        going.append(new[-1])
    return spark.createDataFrame(new, queue.select(*names).schema)


def logged_steps(old: DataFrame, new: DataFrame) -> DataFrame:
    """The steps of agent runs (step_id, run_id, seq, status, updated_at): one a step, as it was written last."""
    return latest(old.unionByName(new), ["step_id"], F.desc("updated_at"), F.desc("status"))


def batch_status(runs: DataFrame) -> DataFrame:
    """Status of each batch of scanner runs (batch, status)."""
    ok, some = F.bool_and(F.col("status") == "SUCCEEDED"), F.bool_or(F.col("status").isin("SUCCEEDED", "PARTIAL"))
    return runs.groupBy("batch").agg(F.when(ok, "SUCCEEDED").when(some, "PARTIAL").otherwise("FAILED").alias("status"))


def changed_files(current: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed, deleted) file paths from current and cached (file_path, hash)."""
    both = current.join(cached.select("file_path", F.col("hash").alias("old")), "file_path", "left")
    return both.filter(~F.col("hash").eqNullSafe(F.col("old"))).select("file_path"), cached.join(current, "file_path", "left_anti").select("file_path")


def merge_first_seen(old: DataFrame, new: DataFrame) -> DataFrame:
    """External findings by fingerprint: the first time seen stays, the last one is renewed."""
    both = old.select("fingerprint", "first_seen", "last_seen").unionByName(new.select("fingerprint", F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen")))
    return both.groupBy("fingerprint").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def evaluate_advice(samples: DataFrame) -> DataFrame:
    """Accuracy of heuristic and suggested verdicts, mean latency, and total cost (null if any cost is unknown)."""
    done = (F.col("status") == "COMPLETED") & F.col("suggested").isNotNull()
    n, m = F.count("*"), F.count_if(done)
    right, good = F.count_if(F.col("heuristic") == F.col("expected")), F.count_if(done & (F.col("suggested") == F.col("expected")))
    cost = F.when(F.count_if(done & F.col("cost").isNull()) > 0, F.lit(None).cast("double")).otherwise(F.coalesce(F.sum(F.when(done, F.col("cost"))), F.lit(0.0)))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return samples.agg(n.alias("samples"), rate(right, n).alias("heuristic_accuracy"), m.alias("available"), rate(good, m).alias("advice_accuracy"), F.coalesce(F.avg(F.when(done, F.col("latency"))), F.lit(0.0)).alias("mean_latency"), cost.alias("total_cost"))


#: Texts of dangerous sinks, of sensitive keys, and places of configuration, in lower case.
DANGEROUS = ("runtime.getruntime().exec", "processbuilder", "executequery(", "executeupdate(", "readobject(", ".lookup(")
SENSITIVE_KEYS = ("password", "secret", "api_key", "api-key", "private_key", "private-key", "access_token", "auth_token")
SENSITIVE_FOLDERS = ("config", "configuration", "secrets")
SENSITIVE_EXTENSIONS = ("yml", "yaml", "properties", "toml", "json", "xml")
MAX_HINT_BYTES = 1024 * 1024


def sensitive_config(path: Column) -> Column:
    """Whether a file may hold configuration with secrets, by its path."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    parts = name.startswith(".env") | name.startswith("application.") | name.contains("credential") | name.contains("secret")
    return F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, SENSITIVE_FOLDERS))) | parts | F.regexp_extract(name, r"\.([^.]+)$", 1).isin(*SENSITIVE_EXTENSIONS)


def _signal(rows: DataFrame, name: str, severity: Column, evidence: int, keep: str = "evidence") -> DataFrame:
    """One row of a signal from rows (place, evidence): their number and the first distinct evidence in order of place."""
    first = rows.filter(F.trim(F.coalesce(keep, F.lit(""))) != "").groupBy(F.col(keep).alias("e")).agg(F.min("place").alias("place"))
    shown = first.orderBy("place", "e").limit(evidence).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "e"))), lambda x: x["e"]), ",").alias("evidence"))
    counted = rows.agg(F.count("*").alias("n"), severity.alias("severity")).filter("n > 0")
    # one row of either side
    return counted.withColumn("k", F.lit(1)).join(shown.withColumn("k", F.lit(1)), "k").select(F.lit(name).alias("signal"), "n", "severity", "evidence")


def risk_signals(units: DataFrame, files: DataFrame, findings: DataFrame, hotspots: DataFrame, evidence: int = 20) -> DataFrame:
    """(signal, n, severity, evidence): the five signals of a project that has any of them.

    Units are its code units, files (file_path, category, size, content) what was scanned, findings (rule_id, status,
    severity, title, qualified_name) its findings, hotspots (file_path, score) the most changed complex files.  Evidence
    is a place of a unit or file, or a title, the first ``evidence`` distinct ones, joined by commas.
    """
    place = F.struct("file_path", "start_line", "id")
    at = F.concat_ws(":", "file_path", F.greatest(F.lit(1), F.col("start_line")).cast("string"))
    callable_ = F.col("kind").isin("METHOD", "CONSTRUCTOR", "FUNCTION") & (F.trim(F.coalesce("raw_source", F.lit(""))) != "")
    has = lambda text, marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.lower(F.coalesce(text, F.lit(""))).contains(m))
    located = lambda rows: rows.select(place.alias("place"), at.alias("evidence"))
    config = files.filter((F.col("category") != "GENERATED") & sensitive_config(F.col("file_path")) & (F.col("size") <= MAX_HINT_BYTES) & has(F.col("content"), SENSITIVE_KEYS))
    open_ = findings.filter("rule_id = 'DEP_VULNERABILITY' AND status NOT IN ('FIXED', 'DISMISSED')")
    named = open_.select(F.struct("title", "qualified_name").alias("place"), F.when(F.trim(F.coalesce("title", F.lit(""))) == "", F.col("qualified_name")).otherwise(F.col("title")).alias("evidence"), "severity")
    worst = F.min_by(F.upper(F.coalesce("severity", F.lit("LOW"))), severity_rank(F.coalesce("severity", F.lit("LOW"))))
    parts = [
        _signal(located(units.filter("is_entry_point")), "PUBLIC_HTTP_ENTRY", F.max(F.lit("MEDIUM")), evidence),
        _signal(located(units.filter(callable_ & has(F.col("raw_source"), DANGEROUS))), "DANGEROUS_SINK", F.max(F.lit("HIGH")), evidence),
        _signal(config.select(F.struct("file_path").alias("place"), F.col("file_path").alias("evidence")), "SENSITIVE_CONFIG", F.max(F.lit("HIGH")), evidence),
        _signal(named, "DEPENDENCY_CVE", worst, evidence),
        _signal(hotspots.orderBy(F.desc("score"), "file_path").limit(10).select(F.struct((-F.col("score")).alias("s"), "file_path").alias("place"), F.col("file_path").alias("evidence")), "HIGH_CHURN_HOTSPOT", F.max(F.lit("MEDIUM")), evidence),
    ]
    return reduce(DataFrame.unionByName, parts)


def whitelisted(citations: DataFrame, known: DataFrame) -> DataFrame:
    """(case_id, kept, rejected): citations that are among the known ones of their case, and the others."""
    both = citations.join(known, "case_id", "left")
    return both.select("case_id", F.array_intersect("cited", F.coalesce("known", F.array())).alias("kept"), F.array_except("cited", F.coalesce("known", F.array())).alias("rejected"))
