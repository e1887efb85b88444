"""Registered queries over the code graph and its metrics, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.adapters import duck, load
from graphlens.functions.code import BRANCHES, complexity
from graphlens.operators import graph, metrics

START = "com.africa.KENYA"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf_dir, "units"), load(spark, sf_dir, "edges")


#: The class with the most methods is a start that is there at every size.
_START = "(SELECT qualified_name FROM units WHERE kind = 'CLASS' ORDER BY id LIMIT 1)"
_SEED = f"SELECT id FROM units WHERE qualified_name = {_START} UNION SELECT dst FROM edges JOIN units ON src = id WHERE kind_e = 'CONTAINS'"
_E = "SELECT src, dst, kind AS kind_e FROM edges"


def _start(units: DataFrame) -> str:
    return units.filter("kind = 'CLASS'").orderBy("id").first()["qualified_name"]


def _walk(kinds: str, forward: bool, depth: int | None) -> dict[str, str]:
    a, b = ("src", "dst") if forward else ("dst", "src")
    seed = f"SELECT id FROM units WHERE qualified_name = {_START} UNION SELECT e.dst FROM edges e JOIN units u ON e.src = u.id WHERE e.kind = 'CONTAINS' AND u.qualified_name = {_START}"
    link = f"SELECT DISTINCT src, dst FROM edges WHERE kind IN ({kinds})"
    if depth is None:
        walk = f"SELECT {b} AS id FROM link JOIN seed ON {a} = seed.id UNION SELECT {b} FROM link JOIN walk ON {a} = walk.id"
    else:
        walk = f"SELECT {b} AS id, 1 AS d FROM link JOIN seed ON {a} = seed.id UNION SELECT {b}, d + 1 FROM link JOIN walk ON {a} = walk.id WHERE d < {depth}"
    return {"seed": seed, "link": link, "walk": walk}


_UNIT = ("id", "qualified_name", "kind", "file_path")


@query(duck("SELECT id, qualified_name, kind, file_path FROM units WHERE id IN (SELECT id FROM walk)", **_walk("'CALLS'", False, 3)))
def g1_find_callers(spark, sf_dir):
    units, edges = _graph(spark, sf_dir)
    return graph.find_callers(units, edges, _start(units), 3).select(*_UNIT)


@query(duck("SELECT id, qualified_name, kind, file_path FROM units WHERE project_id = 'p1' AND id IN (SELECT id FROM walk)", **_walk("'CALLS'", True, 2)))
def g2_find_callees(spark, sf_dir):
    units, edges = _graph(spark, sf_dir)
    return graph.find_callees(units, edges, _start(units), 2, "p1").select(*_UNIT)


@query(duck("SELECT id, qualified_name, kind, file_path FROM units WHERE id IN (SELECT id FROM walk)", **_walk("'CALLS', 'DEFINES_TYPE', 'OVERRIDES', 'EXTENDS', 'IMPLEMENTS'", False, None)))
def g3_impact(spark, sf_dir):
    units, edges = _graph(spark, sf_dir)
    return graph.impact(units, edges, _start(units)).select(*_UNIT)


@query(duck("SELECT id, qualified_name FROM units WHERE id IN (SELECT src FROM edges WHERE kind IN ('EXTENDS', 'IMPLEMENTS') AND dst = (SELECT min(dst) FROM edges WHERE kind = 'EXTENDS'))"))
def g4_subtypes(spark, sf_dir):
    units, edges = _graph(spark, sf_dir)
    first = edges.filter("kind = 'EXTENDS'").agg(F.min("dst").alias("id"))
    name = units.join(first, "id", "left_semi").select("qualified_name").first()
    return graph.subtypes(units, edges, name[0] if name else "").select("id", "qualified_name")


_GAPS = {
    "link": "SELECT DISTINCT src, dst FROM edges WHERE kind = 'CALLS'",
    "walk": "SELECT id, 0 AS d FROM units WHERE project_id = 'p1' AND is_test UNION SELECT dst, d + 1 FROM link JOIN walk ON src = id WHERE d < 6",
    "covered": "SELECT DISTINCT qualified_name FROM units WHERE id IN (SELECT id FROM walk)",
    "gaps": "SELECT id, qualified_name, file_path, start_line FROM units WHERE project_id = 'p1' AND kind IN ('METHOD', 'CONSTRUCTOR', 'FUNCTION') AND NOT is_test AND trim(raw_source) <> '' AND qualified_name NOT IN (SELECT qualified_name FROM covered)",
    "dead": "SELECT id, qualified_name FROM units WHERE project_id = 'p1' AND kind IN ('METHOD', 'FUNCTION') AND id NOT IN (SELECT dst FROM edges WHERE kind = 'CALLS')",
}


@query(duck("SELECT * FROM gaps", **{k: _GAPS[k] for k in ("link", "walk", "covered", "gaps")}))
def g9_test_gaps(spark, sf_dir):
    return graph.test_gaps(*_graph(spark, sf_dir), "p1").select("id", "qualified_name", "file_path", "start_line")


@query(duck("SELECT * FROM dead", dead=_GAPS["dead"]))
def g10_dead_code(spark, sf_dir):
    return graph.dead_code(*_graph(spark, sf_dir), "p1").select("id", "qualified_name")


@query(duck("SELECT src, dst, kind FROM edges WHERE src NOT IN (SELECT id FROM units WHERE file_path LIKE 'src/asia/%') AND dst NOT IN (SELECT id FROM units WHERE file_path LIKE 'src/asia/%')"))
def g11_cascade_delete(spark, sf_dir):
    units, edges = _graph(spark, sf_dir)
    return graph.delete_files(units, edges, units.filter("file_path LIKE 'src/asia/%'").select("project_id", "file_path").distinct())[1]


@query(
    duck(
        "SELECT src, dst, kind, max_by(file_path, seq * 100 + source_line) AS file_path, max_by(source_line, seq * 100 + source_line) AS source_line, project_id FROM (SELECT rows.source_id AS src, coalesce(a.dst, b.dst, c.dst) AS dst, rows.* FROM rows LEFT JOIN by_id a USING (project_id, target_ref) LEFT JOIN by_name b USING (project_id, target_ref) LEFT JOIN by_base c USING (project_id, target_ref)) WHERE dst IS NOT NULL GROUP BY src, dst, kind, project_id",
        rows="SELECT r.*, u.project_id, regexp_replace(target_ref, '::arity=\\d+$', '') AS base, TRY_CAST(regexp_extract(target_ref, '::arity=(\\d+)$', 1) AS INT) AS want FROM raw_edges r JOIN units u ON r.source_id = u.id",
        by_id="SELECT DISTINCT project_id, target_ref, target_ref AS dst FROM rows JOIN units u USING (project_id) WHERE u.id = target_ref",
        by_name="SELECT project_id, target_ref, min(u.id) AS dst FROM rows JOIN units u USING (project_id) WHERE u.qualified_name = target_ref GROUP BY ALL",
        by_base="SELECT project_id, target_ref, min(u.id) AS dst FROM rows JOIN units u USING (project_id) WHERE split_part(u.qualified_name, '(', 1) = base AND contains(u.qualified_name, '(') AND (want IS NULL OR want = CASE WHEN contains(u.qualified_name, '()') THEN 0 ELSE len(string_split(u.qualified_name, ',')) END) GROUP BY project_id, target_ref HAVING count(DISTINCT u.id) = 1",
    )
)
def j1_resolve_edges(spark, sf_dir):
    return graph.resolve_edges(load(spark, sf_dir, "raw_edges"), load(spark, sf_dir, "units"))


_CLASSES = "SELECT DISTINCT split_part(a.qualified_name, '#', 1) AS caller, split_part(b.qualified_name, '#', 1) AS callee FROM edges e JOIN units a ON e.src = a.id JOIN units b ON e.dst = b.id WHERE e.kind = 'CALLS' AND a.project_id = 'p1' AND b.project_id = 'p1' AND contains(a.qualified_name, '#') AND contains(b.qualified_name, '#') AND caller <> callee"
_PACKAGES = "SELECT regexp_extract(caller, '^(.*)\\.[^.]*$', 1) AS src, regexp_extract(callee, '^(.*)\\.[^.]*$', 1) AS dst, count(*) AS n FROM classes WHERE src <> dst GROUP BY ALL"
_COUPLING = "SELECT class, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in, floor(sum(o) / (sum(o) + sum(i)) * 1000 + 0.5) / 1000 AS instability FROM (SELECT caller AS class, 1 AS o, 0 AS i FROM classes UNION ALL SELECT callee, 0, 1 FROM classes) GROUP BY class"
_CYCLES = {
    "closure": "SELECT src, dst FROM packages UNION SELECT c.src, p.dst FROM closure c JOIN packages p ON c.dst = p.src",
    "member": "SELECT a.src, min(a.dst) AS component FROM closure a JOIN closure b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src",
    "cycle": "SELECT component, count(*) AS size, string_agg(src, ',' ORDER BY src) AS members FROM member GROUP BY component HAVING count(*) >= 2",
}


@query(duck("SELECT * FROM classes", classes=_CLASSES))
def j3_class_edges(spark, sf_dir):
    return graph.class_edges(*_graph(spark, sf_dir), "p1")


@query(duck("SELECT * FROM packages", classes=_CLASSES, packages=_PACKAGES))
def a4_package_edges(spark, sf_dir):
    return graph.package_edges(graph.class_edges(*_graph(spark, sf_dir), "p1"))


@query(duck("SELECT * FROM cycle", classes=_CLASSES, packages=_PACKAGES, **_CYCLES))
def g7_package_cycles(spark, sf_dir):
    found = graph.cycles(graph.package_edges(graph.class_edges(*_graph(spark, sf_dir), "p1")))
    return found.select("component", "size", F.array_join("members", ",").alias("members"))


@query(duck("SELECT * FROM coupling", classes=_CLASSES, coupling=_COUPLING))
def a3_coupling(spark, sf_dir):
    return metrics.coupling(graph.class_edges(*_graph(spark, sf_dir), "p1"))


@query(duck("SELECT * FROM coupling ORDER BY fan_out DESC, fan_in DESC, class LIMIT 10", classes=_CLASSES, coupling=_COUPLING))
def t2_top_fan_out(spark, sf_dir):
    return metrics.top_coupling(graph.class_edges(*_graph(spark, sf_dir), "p1"))


@query(duck("SELECT * FROM coupling ORDER BY fan_in DESC, fan_out DESC, class LIMIT 10", classes=_CLASSES, coupling=_COUPLING))
def t2_top_fan_in(spark, sf_dir):
    return metrics.top_coupling(graph.class_edges(*_graph(spark, sf_dir), "p1"), "fan_in")


_CC = "1 + " + " + ".join(f"CAST((length(lower(raw_source)) - length(replace(lower(raw_source), '{t}', ''))) / {len(t)} AS INT)" for t in BRANCHES)
_TARGETS = "SELECT * FROM units WHERE project_id = 'p1' AND kind IN ('METHOD', 'CONSTRUCTOR', 'FUNCTION') AND trim(raw_source) <> ''"


@query(duck(f"SELECT id, {_CC} AS complexity FROM units"))
def f1_complexity(spark, sf_dir):
    return load(spark, sf_dir, "units").select("id", complexity(F.col("raw_source")).alias("complexity"))


@query(duck(f"SELECT id, qualified_name, file_path, {_CC} AS complexity FROM targets WHERE complexity > 1 ORDER BY complexity DESC, id LIMIT 20", targets=_TARGETS))
def t1_top_complexity(spark, sf_dir):
    return metrics.top_complexity(load(spark, sf_dir, "units"), "p1", 20)


_FRAMEWORK = "CASE WHEN regexp_matches(annotations, '@(RestController|Controller|Service|Repository|Component|Configuration)(,|$)') THEN 'spring' WHEN regexp_matches(annotations, '@Mapper(,|$)') THEN 'mybatis' WHEN regexp_matches(annotations, '@Path(,|$)') THEN 'jaxrs' END"


@query(
    duck(
        "SELECT 'total' AS bucket, 'units' AS key, count(*) AS n FROM own UNION ALL SELECT 'total', 'files', count(DISTINCT file_path) FROM own UNION ALL SELECT 'total', 'entry_points', count(*) FROM own WHERE is_entry_point HAVING count(*) > 0 UNION ALL SELECT 'total', 'tests', count(*) FROM own WHERE is_test HAVING count(*) > 0"
        f" UNION ALL SELECT 'kind', kind, count(*) FROM own GROUP BY 2 UNION ALL SELECT 'language', language, count(*) FROM own GROUP BY 2 UNION ALL SELECT 'framework', {_FRAMEWORK} AS f, count(*) FROM own WHERE f IS NOT NULL GROUP BY 2 UNION ALL SELECT 'edge', e.kind, count(*) FROM edges e JOIN own ON e.src = own.id GROUP BY 2",
        own="SELECT * FROM units WHERE project_id = 'p1'",
    )
)
def a1_project_stats(spark, sf_dir):
    return metrics.project_stats(*_graph(spark, sf_dir), "p1")


@query(duck(f"SELECT id, {_FRAMEWORK} AS framework FROM units"))
def p10_framework(spark, sf_dir):
    return load(spark, sf_dir, "units").select("id", metrics.framework(F.col("annotations")).alias("framework"))


_CHURN = "SELECT 'src/' || lower(replace(r_name, ' ', '')) || '/' || replace(n_name, ' ', '') || '.java' AS file_path, count(*) AS changes FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"


@query(
    duck(
        "SELECT file_path, count(*) AS methods, changes, floor(avg(cc) * 100 + 0.5) / 100 AS avg_complexity, floor(ln(changes + 1) * avg(cc) * 100 + 0.5) / 100 AS score FROM files JOIN churn USING (file_path) GROUP BY file_path, changes ORDER BY score DESC, file_path LIMIT 50",
        targets=_TARGETS, files=f"SELECT file_path, {_CC} AS cc FROM targets", churn=_CHURN,
    )
)
def a6_hotspots(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    files = graph.scan_targets(load(spark, sf_dir, "units"), "p1").select("file_path", complexity(F.col("raw_source")).alias("complexity"))
    c, n, r = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    places = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat(F.lit("src/"), F.lower(F.replace("r_name", F.lit(" "), F.lit(""))), F.lit("/"), F.replace("n_name", F.lit(" "), F.lit("")), F.lit(".java"))
    churn = o.join(places, F.col("o_custkey") == F.col("c_custkey")).groupBy(path.alias("file_path")).agg(F.count("*").alias("changes"))
    return metrics.hotspots(files, churn)


@query(
    duck(
        "SELECT package, units AS units, entry_points, coalesce(inbound, 0) AS inbound, coalesce(outbound, 0) AS outbound, coalesce(key_symbols, '') AS key_symbols FROM counts LEFT JOIN into_ USING (package) LEFT JOIN out_ USING (package) LEFT JOIN keys USING (package)",
        classes=_CLASSES, packages=_PACKAGES,
        counts="SELECT regexp_extract(split_part(qualified_name, '#', 1), '^(.*)\\.[^.]*$', 1) AS package, count(*) AS units, CAST(sum(CAST(is_entry_point AS INT)) AS BIGINT) AS entry_points FROM units WHERE project_id = 'p1' GROUP BY 1",
        into_="SELECT dst AS package, CAST(sum(n) AS BIGINT) AS inbound FROM packages GROUP BY 1", out_="SELECT src AS package, CAST(sum(n) AS BIGINT) AS outbound FROM packages GROUP BY 1",
        degree="SELECT regexp_extract(callee, '^(.*)\\.[^.]*$', 1) AS package, callee, count(*) AS n FROM classes GROUP BY ALL",
        keys="SELECT package, string_agg(callee, ',' ORDER BY n DESC, callee) AS key_symbols FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY n DESC, callee) AS r FROM degree) WHERE r <= 5 GROUP BY 1",
    )
)
def a10_package_facts(spark, sf_dir):
    return metrics.package_facts(*_graph(spark, sf_dir), "p1")


_COUNT = "CAST((SELECT count(*) FROM {}) AS BIGINT)"


@query(
    duck(
        "SELECT *, CAST(greatest(0, 100 - least(critical * 15, 45) - least(high * 10, 40) - least(medium * 5, 20) - least(low * 2, 10) - least(cycles * 10, 30) - least(complex * 2, 20) - least(unstable, 10) - CASE WHEN gaps / methods > 0.7 THEN 15 WHEN gaps / methods > 0.5 THEN 10 WHEN gaps / methods > 0.3 THEN 5 ELSE 0 END - CASE WHEN dead / methods > 0.1 THEN 5 ELSE 0 END) AS BIGINT) AS score FROM facts",
        classes=_CLASSES, packages=_PACKAGES, coupling=_COUPLING, targets=_TARGETS, **_CYCLES, **_GAPS,
        active="SELECT severity FROM findings WHERE project_id = 'p1' AND status IN ('SUSPECTED', 'CONFIRMED')",
        facts=f"SELECT {', '.join(_COUNT.format(f'active WHERE severity = {s.upper()!r}') + f' AS {s}' for s in ('critical', 'high', 'medium', 'low'))}, {_COUNT.format('cycle')} AS cycles, {_COUNT.format(f'targets WHERE {_CC} > 10')} AS complex, {_COUNT.format('targets')} AS methods, {_COUNT.format('coupling WHERE instability > 0.8')} AS unstable, {_COUNT.format('gaps')} AS gaps, {_COUNT.format('dead')} AS dead",
    )
)
def a5_health(spark, sf_dir):
    return metrics.health(*_graph(spark, sf_dir), load(spark, sf_dir, "findings"), "p1")


@query(duck("SELECT p.project_id, count(u.id) AS units FROM (SELECT unnest(['p1', 'p2', 'p3']) AS project_id) p LEFT JOIN units u USING (project_id) GROUP BY 1"))
def j10_projects(spark, sf_dir):
    projects = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "project_id string")
    return projects.join(load(spark, sf_dir, "units"), "project_id", "left").groupBy("project_id").agg(F.count("id").alias("units"))


@query(duck("SELECT DISTINCT file_path FROM units WHERE project_id = 'p1' AND trim(file_path) <> ''"))
def p7_file_paths(spark, sf_dir):
    return load(spark, sf_dir, "units").filter("project_id = 'p1' AND trim(file_path) <> ''").select("file_path").distinct().orderBy("file_path")


@query(duck("SELECT id, qualified_name, language FROM units WHERE is_entry_point AND language = 'java'"))
def p6_entry_points(spark, sf_dir):
    return load(spark, sf_dir, "units").filter("is_entry_point AND language = 'java'").select("id", "qualified_name", "language")
