"""Registered queries of retrieval and rule scans, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.adapters import duck, load
from graphlens.functions.code import glob_pattern, in_cidr, redact, version_key
from graphlens.operators import graph, retrieval, security

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _vectors(spark, sf_dir) -> DataFrame:
    """Units with a semantic and a code vector, from the table of embeddings."""
    units, e = load(spark, sf_dir, "units"), load(spark, sf_dir, "embeddings")
    return (
        units.filter("num IS NOT NULL")
        .join(e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("semantic_vec")), F.col("num") % 500 == F.col("a"))
        .join(e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("code_vec")), F.col("num") * 7 % 500 == F.col("b"))
        .drop("a", "b")
    )


def _vector(spark, sf_dir, vec_id: int = 3) -> list[float]:
    return list(load(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"])


_VECTORS = "SELECT u.*, CAST(s.embedding AS DOUBLE[]) AS semantic_vec, CAST(c.embedding AS DOUBLE[]) AS code_vec FROM units u JOIN embeddings s ON u.num % 500 = s.vec_id JOIN embeddings c ON u.num * 7 % 500 = c.vec_id"
_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)"


def _top(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 9).alias("score"))


@query(duck(f"SELECT id, round(list_cosine_similarity(semantic_vec, {_Q}), 9) AS score FROM vectors WHERE project_id = 'p1' AND NOT is_test ORDER BY list_cosine_similarity(semantic_vec, {_Q}) DESC, id LIMIT 10", vectors=_VECTORS))
def v1_semantic_search(spark, sf_dir):
    return _top(retrieval.vector_search(_vectors(spark, sf_dir), "semantic_vec", _vector(spark, sf_dir), 10, where=retrieval.payload_filter(project_id="p1", no_test=True)))


@query(duck(f"SELECT id, round(list_cosine_similarity(code_vec, {_Q}), 9) AS score FROM vectors WHERE language = 'java' ORDER BY list_cosine_similarity(code_vec, {_Q}) DESC, id LIMIT 5 OFFSET 5", vectors=_VECTORS))
def v2_code_search(spark, sf_dir):
    return _top(retrieval.vector_search(_vectors(spark, sf_dir), "code_vec", _vector(spark, sf_dir), 5, 5, retrieval.payload_filter(language="java")))


_OWNED = "SELECT 'p1' AS project_id, 'PERSONAL' AS scope, 'ann' AS owner UNION ALL SELECT 'p2', 'ORG', 'org1'"


@query(duck(f"SELECT id, round(list_cosine_similarity(semantic_vec, {_Q}), 9) AS score FROM vectors WHERE project_id IN (SELECT project_id FROM owned WHERE (scope = 'PERSONAL' AND owner = 'bob') OR (scope = 'ORG' AND owner IN ('org1'))) ORDER BY score DESC, id LIMIT 10", vectors=_VECTORS, owned=_OWNED))
def v3_authorised_search(spark, sf_dir):
    owned = spark.createDataFrame([("p1", "PERSONAL", "ann"), ("p2", "ORG", "org1")], "project_id string, scope string, owner string")
    members = spark.createDataFrame([("bob", "org1", True), ("bob", "org9", False)], "actor string, org string, active boolean")
    units = _vectors(spark, sf_dir)
    return _top(retrieval.vector_search(units.join(accessible(owned, members, "bob"), "project_id", "left_semi"), "semantic_vec", _vector(spark, sf_dir), 10))


def accessible(owned: DataFrame, members: DataFrame, actor: str, admin: bool = False) -> DataFrame:
    """Projects that an actor may read: all for administrators, else their own and those of organizations they are active in."""
    if admin:
        return owned.select("project_id").distinct()
    own = owned.filter((F.col("scope") == "PERSONAL") & (F.col("owner") == actor)).select("project_id")
    orgs = members.filter((F.col("actor") == actor) & F.col("active")).select(F.col("org").alias("owner"))
    return own.unionByName(owned.filter("scope = 'ORG'").join(orgs, "owner", "left_semi").select("project_id")).distinct()


@query(
    "SELECT DISTINCT 'p' || CAST(c_custkey AS VARCHAR) AS project_id FROM customer WHERE (c_custkey % 2 = 0 AND c_custkey % 7 = 3) OR (c_custkey % 2 = 1 AND c_custkey % 5 IN (SELECT s_suppkey % 5 FROM supplier WHERE s_suppkey % 7 = 3 AND s_suppkey % 3 <> 0))"
)
def j9_access(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    name = lambda head, x: F.concat(F.lit(head), x.cast("string"))
    owned = load(spark, sf_dir, "customer").select(name("p", k).alias("project_id"), F.when(k % 2 == 0, "PERSONAL").otherwise("ORG").alias("scope"), F.when(k % 2 == 0, name("u", k % 7)).otherwise(name("org", k % 5)).alias("owner"))
    members = load(spark, sf_dir, "supplier").select(name("u", s % 7).alias("actor"), name("org", s % 5).alias("org"), (s % 3 != 0).alias("active"))
    return accessible(owned, members, "u3")


_TERMS = retrieval.terms_of("How does run1 execute the if (a) token")


def _held(col: str, t: str, w: float) -> str:
    x = f"lower(coalesce({col}, ''))"
    return f"CASE WHEN trim({x}) = '' THEN 0.0 WHEN {x} = '{t}' THEN {2 * w} WHEN ends_with({x}, '{t}') THEN {1.5 * w} WHEN contains({x}, '{t}') THEN {w} ELSE 0.0 END"


def _points(terms: list[str]) -> str:
    return " + ".join(f"{_held('qualified_name', t, 6.0)} + {_held('simple_name', t, 8.0)} + {_held('signature', t, 4.0)} + CAST((length(raw_source) - length(replace(lower(raw_source), '{t}', ''))) / {len(t)} AS INT)" for t in terms)


_SCORE = " + ".join(f"{_held('qualified_name', t, 6.0)} + {_held('simple_name', t, 8.0)} + {_held('signature', t, 4.0)} + CAST((length(raw_source) - length(replace(lower(raw_source), '{t}', ''))) / {len(t)} AS INT)" for t in _TERMS)
_KEYWORD = f"SELECT *, CAST(least(1.0, CAST({_SCORE} AS DOUBLE) / (10 * (1 + log10(greatest(10, length(raw_source)))))) AS FLOAT) AS score FROM (SELECT * FROM units WHERE project_id = 'p1' AND NOT is_test AND trim(raw_source) <> '' ORDER BY file_path, start_line, id LIMIT 5000)"


@query(duck("SELECT id, round(CAST(score AS DOUBLE), 6) AS score FROM keyword WHERE score > 0 ORDER BY keyword.score DESC, qualified_name, id LIMIT 20", keyword=_KEYWORD))
def v4_keyword_search(spark, sf_dir):
    found = retrieval.keyword_search(load(spark, sf_dir, "units"), "How does run1 execute the if (a) token", 20, project_id="p1")
    return found.select("id", F.round(F.col("score").cast("double"), 6).alias("score"))


_STOP = ", ".join(f"'{w}'" for w in ("the", "and", "for", "with", "from", "this", "that", "into", "where", "what", "when", "how", "why", "是否", "这个", "那个"))


@query(f"SELECT item_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^A-Za-z0-9_.$#/-]+'), lambda x: length(x) >= 2 AND x NOT IN ({_STOP})))), ' '), '') AS terms FROM benchmark")
def p13_query_terms(spark, sf_dir):
    items = load(spark, sf_dir, "benchmark")
    return items.select("item_id", F.coalesce(F.array_join(F.sort_array(retrieval.query_terms(F.col("text"))), " "), F.lit("")).alias("terms"))


@query(duck("SELECT id, qualified_name FROM units WHERE project_id = 'p1' AND language = 'python' AND NOT is_test AND trim(raw_source) <> '' ORDER BY file_path, start_line, id LIMIT 50"))
def s26_search_targets(spark, sf_dir):
    return retrieval.search_targets(load(spark, sf_dir, "units"), "p1", "python", limit=50).select("id", "qualified_name")


@query(duck("SELECT id FROM units WHERE project_id = 'p1' AND file_path = (SELECT file_path FROM units WHERE id = 'm3') AND 44 BETWEEN start_line AND end_line ORDER BY end_line - start_line, id LIMIT 1"))
def p3_locate(spark, sf_dir):
    units = load(spark, sf_dir, "units")
    return retrieval.locate(units, units.filter("id = 'm3'").first()["file_path"], 44, "p1").select("id")


_RANK = "CASE WHEN lower(qualified_name) = 'run1' THEN 0 WHEN ends_with(lower(qualified_name), 'run1') THEN 1 WHEN contains(lower(qualified_name), 'run1') THEN 2 WHEN contains(lower(simple_name), 'run1') THEN 3 END"


@query(duck(f"SELECT id, qualified_name, rank FROM (SELECT *, row_number() OVER (PARTITION BY qualified_name ORDER BY rank, id) AS r FROM (SELECT *, {_RANK} AS rank FROM units WHERE project_id = 'p1') WHERE rank IS NOT NULL) WHERE r = 1 ORDER BY rank, length(qualified_name), qualified_name LIMIT 10"))
def p5_find_symbols(spark, sf_dir):
    return retrieval.find_symbols(load(spark, sf_dir, "units"), "Run1", "p1").select("id", "qualified_name", "rank")


def _words(col: str, words, prefix: str = "") -> str:
    return "(" + " OR ".join(f"contains({col}, '{prefix}{w}')" for w in words) + ")"


_N, _QN, _S = "lower(simple_name)", "lower(qualified_name)", "lower(raw_source)"
_MARKS = "list_filter(string_split(lower(annotations), ','), lambda x: x <> '')"
_SECURITY = (
    f"least(1.0, CASE WHEN is_entry_point THEN 0.1 ELSE 0 END + 0.3 * len(list_filter({_MARKS}, lambda x: {_words('x', retrieval.HIGH_ANNOTATIONS)})) + 0.1 * len(list_filter({_MARKS}, lambda x: {_words('x', retrieval.LOW_ANNOTATIONS)}))"
    f" + CASE WHEN {_words(_N, retrieval.HIGH_NAMES)} THEN 0.3 ELSE 0 END + CASE WHEN {_words(_N, retrieval.MEDIUM_NAMES)} OR {_words(_QN, retrieval.MEDIUM_NAMES, '.')} THEN 0.2 ELSE 0 END"
    f" + CASE WHEN {_words(_S, retrieval.SQL_SOURCES)} THEN 0.3 ELSE 0 END + CASE WHEN {_words(_S, retrieval.CRYPTO_SOURCES)} THEN 0.2 ELSE 0 END + CASE WHEN {_words(_S, retrieval.COMMAND_SOURCES)} THEN 0.3 ELSE 0 END)"
)


@query(duck(f"SELECT id, round(CAST({_SECURITY} AS DOUBLE), 6) AS security FROM units"))
def f8_security_score(spark, sf_dir):
    return load(spark, sf_dir, "units").select("id", F.round(retrieval.security_score(), 6).alias("security"))


def _best_impact(seed: int, known: str) -> str:
    """SQL: the first 20 names that a seed has an impact on and that aren't ``known``."""
    return f"SELECT qualified_name, 'IMPACT' AS source, 'IMPACT' AS relation, arg_min(security, id) AS security, 0.2 + 0.5 * arg_min(security, id) AS score FROM impact ANTI JOIN {known} USING (qualified_name) WHERE seed = {seed} AND security > 0 GROUP BY qualified_name ORDER BY qualified_name LIMIT 20"


_RAG = {
    "vectors": _VECTORS,
    "known": f"SELECT *, CAST({_SECURITY} AS DOUBLE) AS security FROM vectors WHERE project_id = 'p1'",
    "found": f"SELECT *, list_cosine_similarity(semantic_vec, {_Q}) AS base FROM known WHERE NOT is_test ORDER BY base DESC, id LIMIT 5",
    "seeds": "SELECT *, row_number() OVER (ORDER BY base DESC, id) AS seed FROM found",
    "targets": "SELECT * FROM known WHERE NOT is_test AND trim(raw_source) <> '' ORDER BY file_path, start_line, id LIMIT 5000",
    "scored": f"SELECT *, CAST(least(1.0, CAST({_points(['run1', 'token'])} AS DOUBLE) / (10 * (1 + log10(greatest(10, length(raw_source)))))) AS FLOAT) AS points FROM targets",
    "words": "SELECT * FROM scored WHERE points > 0 ORDER BY points DESC, qualified_name, id LIMIT 5",
    "calls": "SELECT DISTINCT src, dst FROM edges WHERE kind = 'CALLS'",
    "callers": "SELECT seed, base, k.*, row_number() OVER (PARTITION BY seed ORDER BY k.qualified_name, k.id) AS n FROM (SELECT seed, base AS base, id FROM seeds) s JOIN calls ON dst = s.id JOIN known k ON k.id = src",
    "callees": "SELECT seed, base, k.*, row_number() OVER (PARTITION BY seed ORDER BY k.qualified_name, k.id) AS n FROM (SELECT seed, base AS base, id FROM seeds) s JOIN calls ON src = s.id JOIN known k ON k.id = dst",
    "rows": "SELECT qualified_name, 'VECTOR' AS source, 'SEED' AS relation, security, base + 0.5 * security AS score, [0, seed, 0] AS place FROM seeds UNION ALL SELECT qualified_name, 'KEYWORD', 'SEED', security, points + 0.5 * security, [1, trunc(-points), 0] FROM words"
    " UNION ALL SELECT qualified_name, 'CALL_GRAPH', 'CALLER', security, 0.6 * base + 0.5 * security, [2, seed, 0] FROM callers WHERE n <= 20 UNION ALL SELECT qualified_name, 'CALL_GRAPH', 'CALLEE', security, 0.5 * base + 0.5 * security, [2, seed, 1] FROM callees WHERE n <= 20",
    "got": "SELECT qualified_name, source, relation, security, score FROM (SELECT *, row_number() OVER (PARTITION BY qualified_name ORDER BY place) AS r FROM rows) WHERE r = 1",
    "back": "SELECT DISTINCT dst AS a, src AS b FROM edges WHERE kind IN ('CALLS', 'DEFINES_TYPE', 'OVERRIDES', 'EXTENDS', 'IMPLEMENTS')",
    "walk": "SELECT seed, b AS id FROM seeds JOIN back ON a = seeds.id WHERE seed <= 3 UNION SELECT seed, b FROM walk JOIN back ON a = walk.id",
    "impact": "SELECT seed, known.* FROM walk JOIN known USING (id)",
    "one": _best_impact(1, "got"),
    "got_one": "SELECT * FROM got UNION ALL SELECT * FROM one",
    "two": _best_impact(2, "got_one"),
    "got_two": "SELECT * FROM got_one UNION ALL SELECT * FROM two",
    "three": _best_impact(3, "got_two"),
}


@query(duck("SELECT qualified_name, source, relation, round(CAST(security AS DOUBLE), 6) AS security, round(CAST(score AS DOUBLE), 6) AS score FROM (SELECT * FROM got_two UNION ALL SELECT * FROM three)", **_RAG))
def v6_graph_rag(spark, sf_dir):
    found = retrieval.graph_rag(_vectors(spark, sf_dir), load(spark, sf_dir, "edges"), "semantic_vec", _vector(spark, sf_dir), "run1 token", 5, 1, "p1")
    return found.select("qualified_name", "source", "relation", F.round("security", 6).alias("security"), F.round("score", 6).alias("score"))


@query(
    duck(
        "SELECT rank, id, substr(text, 1, CAST(room AS INT)) AS excerpt, 'C' || CAST(row_number() OVER (ORDER BY rank) AS VARCHAR) AS citation, length(text) > room AS truncated FROM pack WHERE room > 0",
        top="SELECT row_number() OVER (ORDER BY doc_id) AS rank, doc_id AS id, trim(text, ' ') AS text FROM documents WHERE trim(text, ' ') <> ''",
        cap="SELECT *, floor(6000 / greatest(1, least(4, count(*) OVER ()))) AS cap FROM top",
        pack="SELECT *, least(cap, 6000 - coalesce(sum(least(length(text), cap)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room FROM cap",
    )
)
def v7_context_pack(spark, sf_dir):
    """All documents in order; each takes a character of the budget at least, so no more than 6,000 can have a place."""
    from pyspark.sql import Window

    first = load(spark, sf_dir, "documents").filter("trim(text) <> ''").orderBy("doc_id").limit(6000)
    return retrieval.context_pack(first.select(F.row_number().over(Window.orderBy("doc_id")).cast("long").alias("rank"), F.col("doc_id").alias("id"), "text"), 6000)


@query(
    duck(
        "SELECT count(*) AS cases, avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END) AS hit_1, avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END) AS hit_3, avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END) AS hit_5, avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END) AS hit_10, round(avg(coalesce(1.0 / first, 0.0)), 9) AS mrr, round(avg(top), 9) AS mean_top FROM cases",
        ranked="SELECT q.vec_id AS case_id, e.label = q.label AS relevant, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id < 23",
        cases="SELECT case_id, min(CASE WHEN relevant AND rank <= 10 THEN rank END) AS first, max(CASE WHEN rank = 1 THEN score END) AS top FROM ranked GROUP BY 1",
    )
)
def a13_retrieval_benchmark(spark, sf_dir):
    from pyspark.sql import Window

    e = load(spark, sf_dir, "embeddings")
    q = e.filter("vec_id < 23").select(F.col("vec_id").alias("case_id"), F.col("embedding").alias("q"), F.col("label").alias("want"))
    pairs = e.join(F.broadcast(q), F.col("vec_id") != F.col("case_id")).withColumn("score", retrieval.cosine(F.col("embedding"), F.col("q")))  # 23 fixed cases
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "vec_id"))).withColumn("relevant", F.col("label") == F.col("want"))
    return retrieval.evaluate(ranked).withColumns({"mrr": F.round("mrr", 9), "mean_top": F.round("mean_top", 9)})


def _has(words) -> str:
    return "(" + " OR ".join("contains(s, '{}')".format(w.replace("'", "''")) for w in words) + ")"


_S_RULES = {
    "SQL_INJECTION": ("CWE-89", "HIGH", f"{_has(security.EXECUTES)} AND ({_has(security.CONCATENATES)} OR NOT {_has(security.PREPARES)})"),
    "COMMAND_INJECTION": ("CWE-78", "HIGH", _has(security.COMMANDS)),
    "INSECURE_DESERIALIZATION": ("CWE-502", "HIGH", _has(security.DESERIALISES)),
    "WEAK_CRYPTO": ("CWE-327", "MEDIUM", _has(security.WEAK_DIGESTS)),
    "HARDCODED_SECRET": ("CWE-798", "HIGH", f"{_has(security.SECRET_NAMES)} AND {_has(security.ASSIGNS)}"),
    "PATH_TRAVERSAL": ("CWE-22", "HIGH", f"{_has(security.FILES)} AND {_has(security.INPUTS)}"),
    "XXE_INJECTION": ("CWE-611", "HIGH", f"{_has(security.XML_PARSERS)} AND NOT {_has(security.XML_GUARDS)}"),
    "INSECURE_RANDOM": ("CWE-330", "MEDIUM", f"{_has(security.RANDOMS)} AND {_has(security.RANDOM_USES)}"),
    "SENSITIVE_LOG": ("CWE-200", "MEDIUM", f"{_has(security.LOGS)} AND {_has(security.LOGGED)}"),
}


@query(duck(" UNION ALL ".join(f"SELECT project_id, id AS unit_id, file_path, start_line, '{r}' AS rule_id, '{w}' AS cwe, '{v}' AS severity, substr(sha256(project_id || ':{r}:' || id), 1, 16) AS finding_id FROM t WHERE {c}" for r, (w, v, c) in _S_RULES.items()), t="SELECT *, lower(raw_source) AS s FROM units WHERE project_id = 'p1' AND kind IN ('METHOD', 'CONSTRUCTOR', 'FUNCTION') AND trim(raw_source) <> ''"))
def x8_code_scan(spark, sf_dir):
    return security.code_scan(graph.scan_targets(load(spark, sf_dir, "units"), "p1"))


def _key(v: str) -> str:
    nums = f"list_transform(string_split(split_part(trim({v}), '-', 1), '.'), lambda x: coalesce(TRY_CAST(x AS INT), 0))"
    return f"CASE WHEN trim({v}) = '' THEN [-1, -1, -1, -1, -1, -1, -1] ELSE list_concat(list_concat({nums}, [0, 0, 0, 0, 0, 0])[1:6], [CASE WHEN contains({v}, '-') THEN 0 ELSE 1 END]) END"


@query(duck(f"SELECT p_partkey, group_id, artifact_id, version, scope, advisory_id FROM components c JOIN advisories a USING (group_id, artifact_id) WHERE scope <> 'excluded' AND (trim(introduced) = '' OR {_key('version')} >= {_key('introduced')}) AND (trim(fixed) = '' OR {_key('version')} < {_key('fixed')})"))
def j4_affected_components(spark, sf_dir):
    return security.affected_components(load(spark, sf_dir, "components"), load(spark, sf_dir, "advisories")).select("p_partkey", "group_id", "artifact_id", "version", "scope", "advisory_id")


@query(duck(f"SELECT p_partkey, version, row_number() OVER (PARTITION BY group_id, artifact_id ORDER BY {_key('version')}, p_partkey) AS place FROM components"))
def f12_version_order(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("group_id", "artifact_id").orderBy(version_key(F.col("version")), "p_partkey")
    return load(spark, sf_dir, "components").select("p_partkey", "version", F.row_number().over(order).cast("long").alias("place"))


_CONF = "SELECT 'h' || CAST(s_suppkey AS VARCHAR) AS name, s_suppkey AS k FROM supplier"
_LINES = """SELECT name, 1 AS line, 'PASS_MIN_LEN' AS key, CAST(k % 12 AS VARCHAR) AS value FROM host UNION ALL SELECT name, 2, 'MaxAuthTries', CAST(k % 9 AS VARCHAR) FROM host WHERE k % 4 <> 0
UNION ALL SELECT name, 3, 'X11Forwarding', CASE WHEN k % 3 = 0 THEN 'yes' ELSE 'no' END FROM host UNION ALL SELECT name, 4, 'Ciphers', CASE WHEN k % 5 = 0 THEN 'des' ELSE 'aes' END FROM host"""


@query(
    duck(
        "SELECT name, 'len' AS rule_id, 'HIGH' AS severity, CAST(1 AS INT) AS line FROM lines WHERE key = 'PASS_MIN_LEN' AND NOT regexp_full_match(value, '([8-9]|[1-9][0-9]+)')"
        " UNION ALL SELECT h.name, 'tries', 'MEDIUM', max(line) FROM host h LEFT JOIN lines l ON h.name = l.name AND key = 'MaxAuthTries' GROUP BY h.name HAVING NOT coalesce(max(regexp_full_match(value, '([1-5])')), false)"
        " UNION ALL SELECT name, 'x11', 'MEDIUM', line FROM lines WHERE key = 'X11Forwarding' AND value IN ('yes', 'on', '1', 'true', 'enabled')"
        " UNION ALL SELECT name, 'cipher', 'LOW', line FROM lines WHERE key = 'Ciphers' AND regexp_full_match(value, 'des|rc4')",
        host=_CONF, lines=_LINES,
    )
)
def k2_config_audit(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.concat_ws(
        "\n", F.concat(F.lit("PASS_MIN_LEN   "), (k % 12).cast("string"), F.lit("  # least")), F.when(k % 4 != 0, F.concat(F.lit("MaxAuthTries="), (k % 9).cast("string"))).otherwise("# none"),
        F.concat(F.lit('X11Forwarding "'), F.when(k % 3 == 0, "yes").otherwise("no"), F.lit('"')), F.concat(F.lit("Ciphers = '"), F.when(k % 5 == 0, "des").otherwise("aes"), F.lit("'")),
    )
    files = load(spark, sf_dir, "supplier").select(F.concat(F.lit("h"), k.cast("string")).alias("name"), text.alias("content"))
    names = ("rule_id", "severity", "type", "key", "value_pattern", "negate")
    rows = [("len", "HIGH", "PRESENT", "PASS_MIN_LEN", "([8-9]|[1-9][0-9]+)", False), ("tries", "MEDIUM", "VALUE_PATTERN", "MaxAuthTries", "([1-5])", False), ("x11", "MEDIUM", "FORBIDDEN", "X11Forwarding", None, False), ("cipher", "LOW", "VALUE_PATTERN", "Ciphers", "des|rc4", True)]
    rules = [dict(zip(names, r)) for r in rows]
    return security.config_audit(files, rules)


@query(
    duck(
        "SELECT 'brute' AS rule_id, 'HIGH' AS severity, name, CAST(min(line) AS INT) AS line, 'u7' AS value, count(*) AS n, NULL AS time, 'u7 from 1.2.3.4: ' || CAST(count(*) AS VARCHAR) AS detail FROM logs WHERE m = 0 GROUP BY name HAVING count(*) >= 5"
        " UNION ALL SELECT 'outbound', 'HIGH', name, CAST(line AS INT), '10.' || CAST(event_id % 3 AS VARCHAR) || '.0.9', 0, 'ok', 'outbound' FROM logs WHERE m = 1 AND event_id % 3 <> 1",
        logs="SELECT 'log' || CAST(user_id % 20 AS VARCHAR) AS name, event_id, event_id % 4 AS m, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS line FROM events",
    )
)
def k2_threat_report(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 4 == 0, F.lit("Failed password for u7 from 1.2.3.4")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("fw DST=10."), (F.col("event_id") % 3).cast("string"), F.lit(".0.9 ok"))).otherwise("nothing")
    logs = e.groupBy(F.concat(F.lit("log"), (F.col("user_id") % 20).cast("string")).alias("name")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", text.alias("t")))), lambda x: x["t"]), "\n").alias("content"))
    rules = [
        {"rule_id": "brute", "severity": "HIGH", "pattern": r"Failed password for (?:invalid user )?(\S+) from (\S+)", "group": 1, "min_count": 5, "detail": "{1} from {2}: {count}"},
        {"rule_id": "outbound", "severity": "HIGH", "pattern": r"DST=([0-9]{1,3}(?:\.[0-9]{1,3}){3})", "group": 1, "whitelist_checked": True, "time_pattern": r"\b(ok)$"},
    ]
    return security.log_threats(logs, rules, ["10.1.0.0/16", "host.name"])


@query("SELECT c_custkey, CAST(c_custkey % 256 AS VARCHAR) || '.7.' || CAST(c_custkey % 300 AS VARCHAR) || '.1' AS address, c_custkey % 300 <= 255 AND c_custkey % 256 BETWEEN 16 AND 31 AS held FROM customer")
def f18_whitelist(spark, sf_dir):
    k = F.col("c_custkey")
    c = load(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(".", (k % 256).cast("string"), F.lit("7"), (k % 300).cast("string"), F.lit("1")).alias("address"))
    return c.withColumn("held", in_cidr(F.col("address"), F.lit("16.0.0.0/4")))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\\b(password|passwd|secret|token|api[_-]?key|access[_-]?key)(\\s*[:=]\\s*)(\"[^\"]*\"|''[^'']*''|[^\\s,;]+)', '\\1\\2[REDACTED]', 'g'), '(?i)\\bBearer\\s+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'g') AS text FROM documents")
def p18_redaction(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", redact(F.col("text")).alias("text"))


@query(duck("SELECT id, file_path FROM units WHERE regexp_full_match(file_path, 'src/a[^/]*/NATION_[^/].*\\.java')"))
def f15_glob(spark, sf_dir):
    return load(spark, sf_dir, "units").filter(F.rlike("file_path", glob_pattern(F.lit("src/a*/NATION_?**.java")))).select("id", "file_path")


_TOK = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9_]+'), lambda x: length(x) >= 3))"


@query(
    duck(
        "SELECT project_id, seed_id, rule_id, unit_id, sink, round(least(0.95, 0.65 + 0.25 * (CASE WHEN len(list_concat(a, b)) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END) + CASE WHEN sink = 'readObject' THEN 0 WHEN dyn THEN 0.05 ELSE 0 END), 9) AS score, fingerprint FROM (SELECT s.project_id, seed_id, rule_id, u.id AS unit_id, 'executeQuery' AS sink, true AS dyn,"
        + _TOK.format("s.detail") + " AS a, " + _TOK.format("u.raw_source") + " AS b, substr(sha256(s.project_id || '|' || rule_id || '|' || u.id), 1, 16) AS fingerprint FROM seeds s JOIN units u ON s.project_id = u.project_id AND contains(u.raw_source, 'executeQuery(') WHERE u.id NOT IN (SELECT unit_id FROM seeds s2 WHERE s2.project_id = s.project_id AND s2.rule_id = s.rule_id)) ORDER BY score DESC, fingerprint, seed_id, sink LIMIT 500",
        seeds="SELECT DISTINCT project_id, unit_id || ':' || rule_id AS seed_id, rule_id, unit_id, 'st.executeQuery(' || chr(34) || 'select' || chr(34) || ' + name)' AS detail FROM findings WHERE rule_id = 'SQL_INJECTION' AND status = 'CONFIRMED'",
    )
)
def f17_variants(spark, sf_dir):
    """Seeds from all findings; of their variants the operator gives the 500 of the highest scores."""
    findings, units = load(spark, sf_dir, "findings"), load(spark, sf_dir, "units")
    seeds = findings.filter("rule_id = 'SQL_INJECTION' AND status = 'CONFIRMED'").select("project_id", F.concat_ws(":", "unit_id", "rule_id").alias("seed_id"), "rule_id", "unit_id", F.lit('st.executeQuery("select" + name)').alias("detail")).distinct()
    return security.variants(seeds, units).withColumn("score", F.round("score", 9))
