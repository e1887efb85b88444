from pyspark.sql import functions as F

from graphlens.operators import graph, metrics

UNITS = "id string, project_id string, kind string, qualified_name string, simple_name string, file_path string, start_line int, end_line int, raw_source string, is_test boolean, is_entry_point boolean, annotations string"


def units(spark, *rows):
    """Rows (id, qualified_name[, kind[, project[, is_test]]])."""
    full = []
    for r in rows:
        i, qn, kind, project, test = (*r, *("METHOD", "p1", False)[len(r) - 2 :])
        full.append((i, project, kind, qn, qn.split("#")[-1], f"{i}.java", 1, 9, "x", test, False, ""))
    return spark.createDataFrame(full, UNITS)


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, *(r or ["CALLS"])) for a, b, *r in rows], "src string, dst string, kind string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_callers_follow_depth(spark):
    u = units(spark, ("a", "A#a"), ("b", "A#b"), ("c", "A#c"))
    e = edges(spark, ("a", "b"), ("b", "c"))
    assert ids(graph.find_callers(u, e, "A#c", 1)) == ["b"]
    assert ids(graph.find_callers(u, e, "A#c", 2)) == ["a", "b"]
    assert ids(graph.find_callers(u, e, "A#c", 0)) == []
    assert ids(graph.find_callers(u, e, "A#none", 3)) == []
    assert ids(graph.find_callees(u, e, "A#a", 2)) == ["b", "c"]


def test_start_is_found_only_on_a_cycle(spark):
    u = units(spark, ("a", "A#a"), ("b", "A#b"), ("c", "A#c"))
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"))
    assert ids(graph.find_callers(u, e, "A#a", 2)) == ["b", "c"]
    assert ids(graph.find_callers(u, e, "A#a", 3)) == ["a", "b", "c"]
    assert ids(graph.find_callers(units(spark, ("a", "A#a")), edges(spark, ("a", "a")), "A#a", 1)) == ["a"]


def test_class_stands_for_its_members_and_projects_are_apart(spark):
    u = units(spark, ("k", "A", "CLASS"), ("m", "A#m"), ("x", "B#x"), ("y", "B#y", "METHOD", "p2"))
    e = edges(spark, ("k", "m", "CONTAINS"), ("x", "m"), ("y", "m"))
    assert ids(graph.find_callers(u, e, "A", 1)) == ["x", "y"]
    assert ids(graph.find_callers(u, e, "A", 1, "p1")) == ["x"]


def test_impact_crosses_kinds_at_any_distance(spark):
    u = units(spark, *[(c, f"A#{c}") for c in "abcde"])
    e = edges(spark, ("a", "b"), ("b", "c", "EXTENDS"), ("c", "d", "DEFINES_TYPE"), ("e", "d", "IMPORTS"))
    assert ids(graph.impact(u, e, "A#d")) == ["a", "b", "c"]


def test_subtypes_gaps_and_dead_code(spark):
    u = units(spark, ("t", "T#t", "METHOD", "p1", True), ("a", "A#a"), ("b", "A#b"), ("c", "A#c"))
    e = edges(spark, ("t", "a"), ("a", "b"), ("c", "b", "EXTENDS"))
    assert ids(graph.test_gaps(u, e, "p1")) == ["c"]
    assert ids(graph.dead_code(u, e, "p1")) == ["c", "t"]
    assert ids(graph.subtypes(u, e, "A#b")) == ["c"]


def test_edges_resolve_by_id_name_and_unique_base(spark):
    u = units(spark, ("1", "A#f(String)"), ("2", "A#g()"), ("3", "A#g(int)"), ("4", "B#h()"), ("5", "A#f(String)", "METHOD", "p2"))
    raw = spark.createDataFrame(
        [("4", "1", "CALLS", "f", 1, 1), ("4", "A#g()", "CALLS", "f", 2, 2), ("4", "A#g", "CALLS", "f", 3, 3), ("4", "A#g::arity=1", "CALLS", "f", 4, 4), ("4", "A#f", "CALLS", "z", 9, 9), ("4", "C#x()", "CALLS", "f", 5, 5), ("no", "1", "CALLS", "f", 6, 6)],
        "source_id string, target_ref string, kind string, file_path string, source_line int, seq long",
    )
    got = {(r["dst"], r["file_path"], r["source_line"]) for r in graph.resolve_edges(raw, u).collect()}
    assert got == {("1", "z", 9), ("2", "f", 2), ("3", "f", 4)}


def test_cycles_of_packages(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("b", "c"), ("f", "f")], "src string, dst string")
    got = {(r["size"], tuple(r["members"])) for r in graph.cycles(e).collect()}
    assert got == {(2, ("a", "b")), (3, ("c", "d", "e"))}
    assert graph.cycles(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")).count() == 0


def test_strong_components_equal_brute_force(spark):
    """Random graphs with chains, several cycles and loops."""
    import random

    for seed in range(3):
        rng = random.Random(seed)
        pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(20 + 4 * seed)}
        reach = {n: {b for a, b in pairs if a == n} for n in range(14)}
        for _ in range(14):
            reach = {n: own | {x for m in own for x in reach[m]} for n, own in reach.items()}
        groups = {frozenset(m for m in range(14) if m in reach[n] and n in reach[m]) for n in range(14)}
        want = {tuple(sorted(f"n{m:02d}" for m in g)) for g in groups if len(g) > 1}
        got = graph.cycles(spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}") for a, b in pairs], "src string, dst string"))
        assert {tuple(r["members"]) for r in got.collect()} == want


def test_least_ancestors_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(60)]
    reach = {n: {b for a, b in pairs if a == n} for n in range(25)}
    for _ in range(25):
        reach = {n: own | {x for m in own for x in reach[m]} for n, own in reach.items()}
    marks = spark.createDataFrame([(str(n), 100 - n) for n in range(0, 25, 2)], "id string, mark int")
    got = graph.least_ancestors(spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string"), marks, 3).collect()
    want = {(str(b), m) for b in range(25) for m in sorted(100 - n for n in range(0, 25, 2) if b in reach[n])[:3]}
    assert {(r["id"], r["mark"]) for r in got} == want


def test_deleting_files_takes_edges_along(spark):
    u = units(spark, ("a", "A#a"), ("b", "A#b"), ("c", "A#c"))
    left, kept = graph.delete_files(u, edges(spark, ("a", "b"), ("b", "c"), ("a", "c")), u.filter("id = 'b'").select("project_id", "file_path"))
    assert ids(left) == ["a", "c"] and [(r["src"], r["dst"]) for r in kept.collect()] == [("a", "c")]


def test_coupling_and_health(spark):
    c = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C")], "caller string, callee string")
    got = {r["class"]: (r["fan_out"], r["fan_in"], r["instability"]) for r in metrics.coupling(c).collect()}
    assert got == {"A": (2, 0, 1.0), "B": (1, 1, 0.5), "C": (0, 2, 0.0)}
    names = ("critical", "high", "medium", "low", "cycles", "complex", "methods", "unstable", "gaps", "dead")

    def score(**k):
        row = spark.createDataFrame([tuple(k.get(n, 0) for n in names)], ", ".join(f"{n} long" for n in names))
        return row.select(metrics.health_score({n: F.col(n) for n in names}).alias("s")).first()["s"]

    assert score() == 100 and score(high=2) == 80 and score(medium=1) == 95 and score(high=9) == 60 and score(cycles=2) == 80 and score(cycles=9) == 70
    assert score(methods=10, gaps=8) == 85 and score(methods=10, dead=2) == 95
