"""Steps that have to keep up with their input: work dealt out, texts read once, no pairs of everything with everything."""

from pyspark.sql import functions as F

from graphlens.operators import findings as fd
from graphlens.operators import security
from graphlens.sources import read, texts

JAVA = "package p;\nclass A {\n  int k = f(1);\n  int f(int a) { class L { void m() { g(); } }\n    Runnable r = new Runnable() { public void run() { f(2); } };\n    new A(); return g(a); }\n}\n"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_texts_of_one_partition_are_dealt_out(spark):
    own = spark.range(400).coalesce(1).select(F.concat(F.lit("A"), F.col("id"), F.lit(".java")).alias("file_path"), F.lit("java").alias("language"), F.lit(JAVA + "//" + "x" * 1000).alias("content"))
    units = texts.precise_units(own)
    assert units.rdd.getNumPartitions() == 4 and units.count() == 400 * 6
    assert read.tasks_of(100 * read.TASK_BYTES, 4) == 100 and read.tasks_of(0, 4) == 1


def test_units_of_java_are_the_same_without_relations():
    assert texts.java_file("p", "A.java", JAVA, True)[0] == texts.java_file("p", "A.java", JAVA)[0]
    assert [u[5] for u in texts.java_file("p", "A.java", JAVA, True)[0]] == ["p.A", "p.A.k", "p.A#f(int)", "p.L", "p.L#m()", "p.A#run()"]


def test_files_are_read_once_for_units_and_relations(spark):
    own = spark.createDataFrame([("p", "a.py", "python", "import b\nfrom k import z\nclass C:\n    def m(self):\n        pass\n"), ("p", "b.py", "python", "import b\n"), ("p", "k/__init__.py", "python", "")], "project_id string, file_path string, language string, content string")
    units, relations = texts.units_and_relations(own, "id", "qualified_name")
    assert "MapInArrow" not in plan(units) + plan(relations) and units.columns == ["id", "qualified_name"]
    assert sorted(u["qualified_name"] for u in units.collect()) == ["C", "C#m"]
    assert sorted((r["source_id"], r["target_ref"]) for r in relations.filter("kind = 'IMPORTS'").collect()) == [("a.py", "b.py"), ("a.py", "k/__init__.py"), ("b.py", "b.py")]
    # a row a file is not sent to the driver, however small the table looks that the paths come from
    assert "BroadcastHashJoin" not in relations._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def joined_rows(df) -> int:
    """Rows that the largest join of a plan made."""
    df.collect()
    most, open_ = 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            open_.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            open_.append(node.plan())
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        open_ += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_variants_of_many_seeds_of_one_detail(spark):
    """600 seeds in 300 places of one class: the least seeds of the best unit come first; nothing is paired seed by seed."""
    seeds = spark.range(600).select(F.lit("p").alias("project_id"), F.format_string("s%04d", "id").alias("seed_id"), F.lit("R").alias("rule_id"), F.concat(F.lit("u"), F.col("id")).alias("unit_id"), F.lit("st.executeQuery(a + b)").alias("detail"))
    units = spark.range(590, 700).select(F.lit("p").alias("project_id"), F.concat(F.lit("u"), F.col("id")).alias("id"), F.concat(F.lit("executeQuery(x"), F.col("id"), F.when(F.col("id") == 650, "").otherwise(" yyy"), F.lit(")")).alias("raw_source"))
    found = security.variants(seeds, units)
    rows = found.collect()
    assert [(r["seed_id"], r["unit_id"]) for r in rows] == [(f"s{i:04d}", "u650") for i in range(500)]
    assert joined_rows(found) <= 500 * 500
    assert [r["seed_id"] for r in security.variants(seeds.withColumn("rule_id", F.lit(None).cast("string")), units, 2).collect()] == ["s0000", "s0001"]


def test_findings_meet_units_about_their_line_alone(spark):
    units = spark.range(2000).select(F.concat(F.lit("m"), F.col("id")).alias("id"), F.lit("p").alias("project_id"), F.lit("A.java").alias("file_path"), F.concat(F.lit("q"), F.col("id")).alias("qualified_name"), (F.col("id") * 10).cast("int").alias("start_line"), (F.col("id") * 10 + 8).cast("int").alias("end_line"))
    whole = spark.createDataFrame([("c", "p", "A.java", "C", 0, 30000), ("d", "p", "A.java", "D", 5, 4), ("a", "p", "A.java", "E", 10, 18), ("n", "p", "A.java", "N", None, None)], "id string, project_id string, file_path string, qualified_name string, start_line int, end_line int")
    asked = spark.range(3000).select(F.col("id").alias("finding_id"), F.lit("p").alias("project_id"), F.lit("A.java").alias("file_path"), (F.col("id") * 7).cast("int").alias("line"), F.lit("q3").alias("symbol"))
    far = spark.createDataFrame([(9001, "p", "A.java", 40000, "q3"), (9002, "p", "A.java", None, "N"), (9003, "p", "B.java", 4, "none")], "finding_id long, project_id string, file_path string, line int, symbol string")
    found = fd.units_of(asked.unionByName(far), units.unionByName(whole))
    want = {i: "a" if 10 <= 7 * i <= 18 else "c" if 7 * i % 10 == 9 or 7 * i >= 20000 else f"m{7 * i // 10}" for i in range(3000)} | {9001: "m3", 9002: "n", 9003: None}
    assert {r["finding_id"]: r["unit_id"] for r in found.collect()} == want
    assert joined_rows(found) <= 4 * 3003


def test_rule_versions_go_through_few_readers(spark):
    acts = [("r1", 2, "publish", 1, True), ("r1", 1, "submit", 1, True), ("r1", 3, "submit", 2, True), ("r1", 4, "publish", 2, True), ("r1", 5, "rollback", None, True), ("r2", 1, "submit", 1, True), ("r2", 2, "publish", 1, False), (None, 1, "reject", 7, True)]
    own = spark.createDataFrame(acts, "rule_id string, seq int, action string, version long, gate_ok boolean")
    found = fd.published(own)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("r1", 1, "PUBLISHED"), ("r1", 2, "ROLLED_BACK"), ("r2", 1, "IN_REVIEW"), (None, 7, "REJECTED")], key=repr)
    assert "FlatMapGroups" not in plan(found)


def test_archives_of_the_query_stay_under_the_bound_of_entries(spark, tmp_path):
    from graphlens.queries_sources import s11_archive_entries

    spark.range(120_000).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    n = {r["refused"]: r["count"] for r in s11_archive_entries(spark, str(tmp_path)).groupBy("refused").count().collect()}
    assert n == {None: 24_000, "link": 24_000, "absolute": 24_000, "traversal": 24_000, "duplicate": 24_000}


def test_least_marks_of_large_and_small_parts_of_a_graph(spark):
    """A dense part whose nodes have far more marks than are kept, one behind it, and a small part with fewer; two words a mask."""
    import random

    from graphlens.operators import graph

    draw = random.Random(3)
    pairs = {(draw.randrange(150), draw.randrange(150)) for _ in range(900)} | {(5, 200), (200, 201), (300, 301), (301, 302), (302, 300), (400, 401)}
    marks = {i: f"{draw.randrange(10**6):06d}" for i in [*range(0, 150, 1), 200, 300, 302] if i % 7}
    for k in (3, 70):
        got: dict = {}
        for r in graph.least_ancestors(spark.createDataFrame(sorted(pairs), "src long, dst long"), spark.createDataFrame(sorted(marks.items()), "id long, mark string"), k).collect():
            got.setdefault(r["id"], []).append(r["mark"])
        before: dict = {}
        for _ in range(160):
            before = {d: set().union(*[before.get(s, set()) | ({marks[s]} if s in marks else set()) for s, x in pairs if x == d]) for d in {d for _, d in pairs}}
        assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v)[:k] for i, v in before.items() if v}


def test_a_finding_of_two_units_has_each_name_once(spark):
    from graphlens.operators import retrieval

    columns = "id string, qualified_name string, simple_name string, raw_source string, annotations string, is_entry_point boolean, file_path string, kind string, signature string"
    units = spark.createDataFrame([(i, f"q{i}", f"login{i}", "password", "", False, "a", "METHOD", "") for i in "abc"], columns)
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS")], "src string, dst string, kind string")
    findings = spark.createDataFrame([("1", "b"), ("2", "b"), ("2", "c"), ("2", "c"), ("3", None)], "finding_id string, unit_id string")
    rows = sorted((r["finding_id"], r["qualified_name"], r["relation"]) for r in retrieval.finding_context(findings, units, edges).collect())
    assert rows == [("1", "qa", "CALLER"), ("1", "qb", "FINDING"), ("1", "qc", "CALLEE"), ("2", "qa", "CALLER"), ("2", "qb", "FINDING"), ("2", "qc", "FINDING")]
