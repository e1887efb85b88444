import json

from pyspark.sql import functions as F

from graphlens.operators import findings, flow, graph, security
from graphlens.plans import exports, index
from graphlens.sources import files, flows, importers, manifests, rules, texts
from graphlens.streaming import feed


def test_files(spark):
    df = spark.createDataFrame([("src/A.java",), ("build/B.java",), ("docs/a.md",), ("src/test/FooTest.java",), ("x.bin",), ("web/app.TS",)], "p string")
    got = {r["p"]: (r["i"], r["c"], r["l"]) for r in df.select("p", files.included(F.col("p")).alias("i"), files.classified(F.col("p")).alias("c"), files.language(F.col("p")).alias("l")).collect()}
    assert got == {
        "src/A.java": (True, "BUSINESS", "java"), "build/B.java": (False, "GENERATED", "java"), "docs/a.md": (False, "DOCUMENTATION", "doc"),
        "src/test/FooTest.java": (True, "TEST", "java"), "x.bin": (False, "UNKNOWN", None), "web/app.TS": (True, "BUSINESS", "typescript"),
    }


def test_scan_reads_wanted_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "target" / "b.py").write_text("y\n")
    got = files.scan(spark, str(tmp_path)).collect()
    assert [(r["file_path"], r["content"]) for r in got] == [("src/a.py", "x = 1\n")]


def test_archive_entries(spark):
    rows = [("z", "a/b.txt", False), ("z", "../x", False), ("z", "/abs", False), ("z", "l", True), ("z", "d", False), ("z", "./d", False)]
    got = {r["name"]: r["refused"] for r in files.archive_entries(spark.createDataFrame(rows, "archive string, name string, is_link boolean")).collect()}
    assert got == {"a/b.txt": None, "../x": "traversal", "/abs": "absolute", "l": "link", "d": "duplicate", "./d": "duplicate"}


def test_sections(spark):
    df = spark.createDataFrame([("d/r.md", "intro\n# One\ntext\n## One\nmore\n#### deep\n# Blank")], "file_path string, content string")
    got = [(r["qualified_name"], r["start_line"], r["end_line"]) for r in texts.sections(df).orderBy("start_line").collect()]
    assert got == [("d/r.md#r.md", 1, 1), ("d/r.md#One", 2, 3), ("d/r.md#One-L4", 4, 6), ("d/r.md#Blank", 7, 7)]


def test_units_of_python_and_heuristics(spark):
    rows = [("m.py", "python", "class A:\n    def f(self, x):\n        return x\n\ndef g():\n    pass\n"), ("b.py", "python", "def broken(:\n    pass\n"), ("A.java", "java", "public class A {\n  void run(int a) {\n    go();\n  }\n}\n")]
    got = {(r["file_path"], r["simple_name"], r["start_line"], r["end_line"], r["degraded"]) for r in texts.dispatched(spark.createDataFrame(rows, "file_path string, language string, content string")).collect()}
    assert {("m.py", "A", 1, 3, False), ("m.py", "f", 2, 3, False), ("m.py", "g", 5, 6, False), ("b.py", "broken", 1, 2, True), ("A.java", "A", 1, 5, False), ("A.java", "run", 2, 4, False)} == got
    df = spark.createDataFrame(rows, "file_path string, language string, content string")
    assert {r["file_path"] for r in texts.dispatched(df, "PRECISE").collect()} == {"m.py", "A.java"}
    assert all(r["degraded"] for r in texts.dispatched(df, "HEURISTIC").collect())


JAVA = """package com.a;
import com.b.Dao;
import static com.u.Util.check;
public class Svc extends Base implements Filter, Runnable {
  private final Dao dao = make("x");
  public Svc(Dao dao) { this(dao, 1); }
  Svc(Dao dao, int k) { this.dao = dao; }
  @Override
  public List<String> find(String name, int... ids) throws IOException {
    String q = "a" + name; // call( {
    for (Dao d : all()) { d.close(); }
    if (a < b) helper(q);
    helper(q, 1);
    new Thread(new Runnable() { public void run() { helper("z"); } }).start();
    this.dao.query(name).size();
    check(name);
    Other.stat((String) q);
    list.forEach(this::helper);
    return out;
  }
  void helper(String s) { }
  private void helper(String s, int k) { }
  enum E { A(1) { void x() {} }, B; void y() { x(); } }
  record P(int a, String b) { int z() { return a; } }
  @interface Mark { int v() default 5; }
}
"""


def test_java_units_and_relations():
    units, relations = texts.java_file("p", "src/com/a/Svc.java", JAVA)
    name = {u[0]: u[5] for u in units}
    assert [(u[4], u[5], u[7], u[8]) for u in units] == [
        ("CLASS", "com.a.Svc", 4, 26), ("FIELD", "com.a.Svc.dao", 5, 5), ("CONSTRUCTOR", "com.a.Svc#Svc(Dao)", 6, 6), ("CONSTRUCTOR", "com.a.Svc#Svc(Dao,int)", 7, 7),
        ("METHOD", "com.a.Svc#find(String,int...)", 8, 20), ("METHOD", "com.a.Svc#run()", 14, 14), ("METHOD", "com.a.Svc#helper(String)", 21, 21), ("METHOD", "com.a.Svc#helper(String,int)", 22, 22),
        ("ENUM", "com.a.Svc$E", 23, 23), ("METHOD", "com.a.Svc$E#x()", 23, 23), ("METHOD", "com.a.Svc$E#y()", 23, 23), ("CLASS", "com.a.Svc$P", 24, 24), ("METHOD", "com.a.Svc$P#z()", 24, 24), ("ANNOTATION", "com.a.Svc$Mark", 25, 25),
    ]
    assert [u[5] for u in units if u[13]] == ["com.a.Svc#find(String,int...)"]  # called by a framework
    calls = [(name.get(r[0], r[0]).split("#")[-1], name.get(r[1], r[1])) for r in relations if r[2] == "CALLS"]
    assert calls == [
        ("com.a.Svc.dao", "com.a.Svc#make(String)"), ("Svc(Dao)", "com.a.Svc#Svc(Dao,int)"), ("find(String,int...)", "com.a.Svc#all()"), ("find(String,int...)", "com.b.Dao#close()"),
        ("find(String,int...)", "com.a.Svc#helper(String)"), ("find(String,int...)", "com.a.Svc#helper(String,int)"), ("find(String,int...)", "com.a.Runnable#<init>()"), ("run()", "com.a.Svc#helper(String)"),
        ("find(String,int...)", "com.a.Thread#<init>(Object)"), ("find(String,int...)", "com.a.Svc#start()"), ("find(String,int...)", "com.b.Dao#query(String)"), ("find(String,int...)", "this.dao#size()"),
        ("find(String,int...)", "com.u.Util#check(String)"), ("find(String,int...)", "com.a.Other#stat(String)"), ("find(String,int...)", "com.a.Svc#helper"), ("find(String,int...)", "com.a.Svc#forEach::arity=1"),
        ("y()", "com.a.Svc$E#x()"),
    ]
    kinds = {(name.get(r[0], r[0]), r[2], name.get(r[1], r[1])) for r in relations}
    assert {("com.a.Svc", "EXTENDS", "com.a.Base"), ("com.a.Svc", "IMPLEMENTS", "com.a.Filter"), ("com.a.Svc#find(String,int...)", "OVERRIDES", "com.a.Svc#find"), ("com.a.Svc", "CONTAINS", "com.a.Svc$E"), ("src/com/a/Svc.java", "IMPORTS", "com.b.Dao")} <= kinds


SCRIPT = """import x from "y";
// c {
export function main(a, b) { helper(a); console.log(skip(1)); this.other(b); later(); return /re{/.test(a) ? `t` : main(); }
async function helper(x) { return x.map(y => main(y)); }
const later = async (p) => { helper(p); new Foo(p).go(); };
const val = { m() { helper(1); } }, other = function (q) { return later(q) };
export default class Box extends Base {
  size = 3;
  static make(n) { return new Box(n); }
  get w() { return this.make(1); }
  handler = () => { hidden(); };
}
describe("x", () => { function inner() { main(); } });
module.exports = { run(a) { helper(a); }, b: 1 };
interface Shape { x: number; }
type T = A | B;
enum E { A, B }
"""
C_SOURCE = """#include "util.h"
#include <stdio.h>
#define MAX 10
#define SQ(x) ((x)*(x))
struct point { int x, y; const char *name; };
typedef struct point point_t;
enum color { RED, GREEN };
static int helper(int a, const char *s);
static int helper(int a, const char *s) { printf("%d", a); return twice(a); }
struct point *make(struct point *p, unsigned long n) { helper(1, "x"); p->cb(2); return p; }
int main(void) { for (int i = 0; i < 3; i++) { make(0, i); } return 0; }
#ifdef X
int hidden(void) { return 1; }
#endif
int twice(int a) { return a * 2; }
int glob = 3;
union u { int a; float b; };
"""


def test_scripts():
    units, relations = texts.PARSERS["typescript"]("p", "a.ts", SCRIPT)
    name = {u[0]: u[5] for u in units}
    assert [(u[4], u[5], u[7], u[8]) for u in units] == [
        ("FUNCTION", "main", 3, 3), ("FUNCTION", "helper", 4, 4), ("FUNCTION", "later", 5, 5), ("FUNCTION", "other", 6, 6), ("CLASS", "Box", 7, 12), ("FIELD", "Box.size", 8, 8), ("METHOD", "Box.make", 9, 9), ("METHOD", "Box.w", 10, 10),
        ("FIELD", "Box.handler", 11, 11), ("FUNCTION", "inner", 13, 13), ("FUNCTION", "run", 14, 14), ("INTERFACE", "Shape", 15, 15), ("TYPEDEF", "T", 16, 16), ("ENUM", "E", 17, 17),
    ]
    assert {u[5] for u in units if u[13]} == {"main", "run"}
    known = [(name[r[0]], name[r[1]]) for r in relations if r[1] in name]
    assert known == [("main", "main"), ("helper", "main"), ("later", "helper"), ("other", "later"), ("Box.w", "Box.make"), ("inner", "main"), ("run", "helper")]
    unknown = {(name[r[0]], c) for r in relations for c in ("helper", "skip", "other", "later", "test", "map", "go", "log", "Foo") if r[1] == texts.unit_id("", "", "FUNCTION", c)}
    assert unknown == {("main", "helper"), ("main", "other"), ("main", "later"), ("main", "test"), ("helper", "map"), ("later", "go")}


def test_c_sources(spark):
    units, relations = texts.c_file("p", "src/a.c", C_SOURCE)
    name = {u[0]: u[5] for u in units}
    assert [(u[4], u[5], u[7], u[10]) for u in units] == [
        ("MACRO", "MAX", 3, "#define MAX"), ("MACRO", "SQ", 4, "#define SQ(...)"), ("STRUCT", "point", 5, "struct point"), ("FIELD", "point.x", 5, "int x"), ("FIELD", "point.y", 5, "int y"), ("FIELD", "point.name", 5, "char name"),
        ("TYPEDEF", "point_t", 6, "typedef ... point_t"), ("ENUM", "color", 7, "enum color"), ("FUNCTION", "helper", 8, "int helper(int,char)"), ("FUNCTION", "helper", 9, "int helper(int,char)"),
        ("FUNCTION", "make", 10, "struct point make(struct point,unsigned long)"), ("FUNCTION", "main", 11, "int main(void)"), ("FUNCTION", "twice", 15, "int twice(int)"), ("UNION", "u", 17, "union u"), ("FIELD", "u.a", 17, "int a"), ("FIELD", "u.b", 17, "float b"),
    ]
    assert [(name[r[0]], name.get(r[1])) for r in relations if r[2] == "CALLS"] == [("helper", None), ("make", "helper"), ("make", None), ("main", "make")]
    rows = [("p", "src/a.c", "c", C_SOURCE), ("p", "src/util.h", "c", "int f(void);"), ("p", "b.c", "c", '#include "src/util.h"\n#include "none.h"\n')]
    raw = texts.relations(spark.createDataFrame(rows, "project_id string, file_path string, language string, content string"))
    assert {(r["source_id"], r["target_ref"]) for r in raw.filter("kind = 'IMPORTS'").collect()} == {("src/a.c", "src/util.h"), ("b.c", "src/util.h")}
    flow_ = flows.java_cfg("make", "static int f(int a) {\n  while (a > 0) { a--; }\n  return g(a);\n}", 5, 8)
    assert [(a, b, k) for _, a, b, k, *_ in flow_] == [(0, 1, "NEXT"), (1, 2, "TRUE_BRANCH"), (2, 1, "LOOP_BACK"), (1, 3, "FALSE_BRANCH"), (3, 4, "NEXT")]


def test_java_that_is_no_java():
    """What does not parse gives what can be read, and never fails."""
    for text in ("", "class", "class A { void f( {", "}}}} class B { int x = ; }", "package ;", 'class C { String s = "unclosed; }', "class D { void f() { a.b(( } }", "\x00 é 中 class E<T extends F<G>> { }"):
        texts.java_file("p", "a/B.java", text)


def test_files_to_callers(spark):
    """From sources of two languages to resolved relations and the callers of a method."""
    rows = [
        ("p1", "com/a/A.java", "java", "package com.a;\nimport com.b.B;\nclass A { B b; void run() { b.go(1); } }\n"), ("p1", "com/b/B.java", "java", "package com.b;\npublic class B { public void go(int n) { stop(); } void stop() { } }\n"),
        ("p1", "m.py", "python", "import pkg.sub\nclass K:\n    def a(self):\n        self.b()\n    def b(self):\n        pass\n"), ("p1", "pkg/sub/__init__.py", "python", "def f():\n    f()\n"),
    ]
    files_ = spark.createDataFrame(rows, "project_id string, file_path string, language string, content string")
    units, raw = texts.precise_units(files_), texts.relations(files_)
    imports = {(r["source_id"], r["target_ref"]) for r in raw.filter("kind = 'IMPORTS'").collect()}
    assert imports == {("com/a/A.java", "com/b/B.java"), ("m.py", "pkg/sub/__init__.py")}
    edges = graph.resolve_edges(raw, units)
    assert {r["qualified_name"] for r in graph.find_callers(units, edges, "com.b.B#stop()", 3, "p1").collect()} == {"com.a.A#run()", "com.b.B#go(int)"}
    assert {r["qualified_name"] for r in graph.find_callers(units, edges, "K#b", 1).collect()} == {"K#a"}
    assert {r["qualified_name"] for r in graph.find_callers(units, edges, "f", 1).collect()} == {"f"}


def _report(spark, content):
    return spark.createDataFrame([("r", json.dumps(content))], "name string, content string")


def test_semgrep(spark):
    flow_ = {"source": {"path": "a", "line": 1}, "intermediate_vars": [{"path": "a", "line": 2}], "sink": {"path": "a", "line": 3}}
    got = importers.semgrep(_report(spark, {"results": [{"check_id": "r1", "path": "a.py", "start": {"line": 5}, "end": {"line": 3}, "extra": {"severity": "ERROR", "message": "m", "metadata": {"cwe": "CWE-89: x"}, "dataflow_trace": flow_}}, {"check_id": "r2", "path": "", "start": {"line": 1}}]})).collect()
    assert [(r["rule_id"], r["cwe"], r["severity"], r["start_line"], r["end_line"], [s["kind"] for s in r["trace"]]) for r in got] == [("r1", "CWE-89", "CRITICAL", 5, 5, ["source", "call", "sink"])]


def test_sarif_and_slither(spark):
    place = lambda n: {"physicalLocation": {"artifactLocation": {"uri": "a.js"}, "region": {"startLine": n}}}
    run = {
        "results": [{"ruleId": "q", "level": "warning", "message": {"text": "t"}, "locations": [place(4)], "codeFlows": [{"threadFlows": [{"locations": [{"location": place(1)}, {"location": place(2)}, {"location": place(4)}]}]}]}],
        "tool": {"driver": {"name": "CodeQL", "rules": [{"id": "q", "properties": {"tags": ["external/cwe/cwe-079"]}}]}},
    }
    r = importers.sarif(_report(spark, {"runs": [run]})).first()
    assert (r["tool"], r["cwe"], r["severity"], r["start_line"], [s["kind"] for s in r["trace"]]) == ("codeql", "CWE-079", "MEDIUM", 4, ["source", "call", "sink"])
    d = {"check": "reentrancy", "impact": "High", "description": "x", "elements": [{"name": "f", "source_mapping": {"filename_relative": "a.sol", "lines": [0, 7, 5, 6]}}]}
    s = importers.slither(_report(spark, {"results": {"detectors": [d]}})).first()
    assert (s["rule_id"], s["severity"], s["start_line"], s["end_line"], s["symbol"]) == ("reentrancy", "HIGH", 5, 7, "f")


POM = """<project xmlns="http://maven.apache.org/POM/4.0.0"><dependencyManagement><dependencies><dependency><groupId>m</groupId><artifactId>managed</artifactId><version>1</version></dependency></dependencies></dependencyManagement>
<dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1.2</version></dependency><dependency><groupId>g</groupId><artifactId>t</artifactId><scope>test</scope></dependency></dependencies></project>"""


def test_manifests(spark):
    rows = [
        ("mvn", "pom.xml", POM), ("js", "package.json", json.dumps({"dependencies": {"@s/x": "^1.2.3"}, "devDependencies": {"j": "~2"}})), ("py", "requirements.txt", "# c\n-r x\nFoo_bar>=1.0\nbaz\n"),
        ("gr", "gradle/libs.versions.toml", '[versions]\nguava = "31.1"\n[libraries]\nguava-core = { module = "com.google:guava", version.ref = "guava" }\n'),
        ("gr", "build.gradle", 'implementation(libs.guava.core)\ntestImplementation("junit:junit:4.13")\nimplementation("com.google:guava:1")\n'),
    ]
    got = {(r["project_id"], r["group_id"], r["artifact_id"], r["version"], r["scope"]) for r in manifests.components(spark.createDataFrame(rows, "project_id string, file_path string, content string")).collect()}
    assert got == {
        ("mvn", "g", "a", "1.2", "required"), ("mvn", "g", "t", "", "excluded"), ("js", "", "@s/x", "1.2.3", "required"), ("js", "", "j", "2", "excluded"), ("py", "", "Foo_bar", "1.0", "required"), ("py", "", "baz", "", "required"),
        ("gr", "com.google", "guava", "31.1", "required"), ("gr", "junit", "junit", "4.13", "excluded"),
    }
    documents = exports.cyclonedx(manifests.components(spark.createDataFrame(rows[:1], "project_id string, file_path string, content string"))).collect()
    assert json.loads(documents[0]["document"])["components"][0]["purl"] == "pkg:maven/g/a@1.2"


def test_config_lines(spark):
    df = spark.createDataFrame([("f", "a = 1 # c\n# all\nKey 'v'\nonly\n")], "name string, content string")
    assert [(r["line"], r["key"], r["value"]) for r in security.config_lines(df).orderBy("line").collect()] == [(1, "a", "1"), (3, "Key", "v")]


def test_protection_needs_its_place_on_the_trace(spark):
    step = "struct<file_path: string, start_line: int, end_line: int, kind: string, symbol: string, message: string>"
    kinds = lambda *k: [("a", i + 1, i + 1, x, "", "") for i, x in enumerate(k)]
    rows = [("f1", "CWE-89", "FINDING", "", "PreparedStatement p", "a", 2, 2, "q", kinds("source", "sanitizer", "sink")), ("f2", "CWE-89", "FINDING", "", "PreparedStatement p", "a", 3, 3, "q", kinds("source", "sink", "guard")), ("f3", "CWE-22", "FINDING", "", "PreparedStatement", "a", 1, 1, "q", [])]
    df = spark.createDataFrame(rows, f"finding_id string, cwe string, source string, relation string, excerpt string, file_path string, start_line int, end_line int, qualified_name string, trace array<{step}>")
    assert {r["finding_id"]: r["aligned"] for r in findings.protections(df).collect()} == {"f1": True, "f2": False}


def test_taint_direct_two_hops_and_cycle(spark):
    s = spark.createDataFrame([("a", 0, "CALL_ARG", "b", 0), ("b", 0, "SINK", "exec", 0), ("b", 0, "CALL_ARG", "a", 0)], "method string, from_param int, kind string, callee string, to_index int")
    c = spark.createDataFrame([("a", "b", "b"), ("b", "a", "a")], "method string, callee_method string, callee_name string")
    e = spark.createDataFrame([("a", 0), ("x", 0)], "entry string, param int")
    paths = flow.taint_paths(s, c, e, 6)
    assert [(r["entry"], r["sink"], r["depth"], r["path"]) for r in paths.collect()] == [("a", "exec", 2, ["a:0", "b:0"])]
    found = flow.taint_findings(paths, "p1")
    assert found.first()["rule_id"] == "COMMAND_INJECTION_TAINT"
    assert [r["role"] for r in flow.evidence(found).orderBy("sequence").collect()] == ["SOURCE", "PROPAGATION", "SINK"]


def test_taint_bounds(spark):
    """Methods in a queue's order, no more than the bound; paths no more than theirs; what is left out is told."""
    s = spark.createDataFrame([(m, 0, "CALL_ARG", "go", 0) for m in "abcd"] + [(m, 0, "SINK", "exec", 0) for m in "bcde"], "method string, from_param int, kind string, callee string, to_index int")
    c = spark.createDataFrame([("a", "b", "go"), ("a", "c", "go"), ("b", "d", "go"), ("c", "e", "go")], "method string, callee_method string, callee_name string")
    e = spark.createDataFrame([("a", 0)], "entry string, param int")

    def run(**bounds):
        paths, runs = flow.taint(s, c, e, **bounds)
        r = runs.first()
        return sorted(p["path"][-1] for p in paths.collect()), r["methods"], r["truncated"]

    assert run() == (["b:0", "c:0", "d:0", "e:0"], 5, False)
    assert run(max_methods=1) == ([], 1, True)
    assert run(max_methods=3) == (["b:0", "c:0"], 3, True)
    assert run(max_paths=2) == (["b:0", "c:0"], 5, True)
    assert run(depth=1) == (["b:0", "c:0"], 3, True)


def test_sinks_have_their_rules(spark):
    want = {
        "executeQuery": "SQL_INJECTION_TAINT", "executeUpdate": "SQL_INJECTION_TAINT", "executeBatch": "SQL_INJECTION_TAINT", "executeLargeUpdate": "SQL_INJECTION_TAINT", "execute": "SQL_INJECTION_TAINT", "exec": "COMMAND_INJECTION_TAINT",
        "start": "COMMAND_INJECTION_TAINT", "readObject": "INSECURE_DESER_TAINT", "readUnshared": "INSECURE_DESER_TAINT", "deserialize": "INSECURE_DESER_TAINT", "loadClass": "UNSAFE_REFLECTION_TAINT", "forName": "UNSAFE_REFLECTION_TAINT",
        "invoke": "UNSAFE_REFLECTION_TAINT", "newInstance": "UNSAFE_REFLECTION_TAINT", "lookup": "JNDI_INJECTION_TAINT", "write": "XSS_TAINT", "print": "XSS_TAINT", "println": "XSS_TAINT", "sendRedirect": "OPEN_REDIRECT_TAINT",
        "sendError": "XSS_TAINT", "parse": "XXE_TAINT", "search": "LDAP_INJECTION_TAINT", "other": "TAINT_SINK",
    }
    paths = spark.createDataFrame([("e", 0, "SINK", k, 1, ["e:0"]) for k in want], "entry string, param int, end string, sink string, depth int, path array<string>")
    assert {r["sink"]: r["rule_id"] for r in flow.taint_findings(paths, "p").collect()} == want


def test_many_events_fold_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(findings, "BLOCK_EVENTS", 3)
    acts = ["claim", "confirm", "claim", "return"]
    rows = [("k", i, acts[i * 7 % 4], f"u{i}") for i in range(40)] + [("z", 0, "claim", "ann"), ("z", 1, "return", "ann"), ("z", 2, "claim", "bob")]
    df = spark.createDataFrame(rows, "entry string, seq long, action string, actor string")
    table = {(a, act): b for a, act, b in findings.REVIEW}
    want, log = {}, []
    for key in ("k", "z"):
        state, n = "PENDING", 0
        for place, (_, _, act, who) in enumerate(r for r in rows if r[0] == key):
            if (state, act) in table:
                log.append((key, place, act, state, table[state, act], who))
                state, n = table[state, act], n + 1
        want[key] = (state, n)
    assert {r["entry"]: (r["state"], r["changes"]) for r in findings.fold(df, "entry", ["seq"], "action", findings.REVIEW, "PENDING").collect()} == want
    changes = findings.audit(df, "entry", ["seq"], "action", findings.REVIEW, "PENDING")
    assert sorted(tuple(r) for r in changes.collect()) == sorted(log)
    assert [(r["entry"], r["state"], r["claimed_by"]) for r in findings.claims(changes.filter("entry = 'z'"), "entry").collect()] == [("z", "IN_REVIEW", "bob")]


def test_quotas_pass_over_full_projects_and_scanners(spark):
    queue = spark.createDataFrame([("a", "p", "s1", 1), ("b", "p", "s2", 2), ("c", "p", "s3", 3), ("d", "q", "s1", 4), ("e", "q", "s1", 5), ("f", "r", "s4", 6)], "task_id string, project_id string, scanner string, seq long")
    none = queue.limit(0).drop("seq")
    assert [r["task_id"] for r in findings.started(queue, none).collect()] == ["a", "b", "d", "f"]
    assert [r["task_id"] for r in findings.started(queue, queue.filter("task_id IN ('a', 'b', 'd', 'f')").drop("seq")).collect()] == []


def test_rules_from_files(spark, tmp_path):
    (tmp_path / "adv.json").write_text(json.dumps([{"id": "A1", "groupId": "g", "artifactId": "a", "fixed": "2.0", "more": 1}, {"id": "A1", "groupId": "g", "artifactId": "a"}, {"id": None}]))
    (tmp_path / "conf.json").write_text(json.dumps([{"id": "c", "severity": "HIGH", "type": "PRESENT", "key": "K", "unknown": {}}]))
    (tmp_path / "threat.json").write_text(json.dumps([{"id": "t", "severity": "LOW", "pattern": "x(.)", "group": 1, "minCount": 3}]))
    seed = rules.advisories(spark, str(tmp_path / "adv.json"))
    assert seed.count() == 1 and rules.advisories(spark, str(tmp_path / "none.json"), seed).count() == 1
    assert rules.config_rules(spark, str(tmp_path / "conf.json")) == [{"rule_id": "c", "severity": "HIGH", "type": "PRESENT", "key": "K", "value_pattern": None, "negate": False}]
    assert rules.threat_rules(spark, str(tmp_path / "threat.json"))[0]["min_count"] == 3


def test_replace_files_keeps_edges_into_living_units(spark):
    u = spark.createDataFrame([("1", "p", "A#a()", "a"), ("2", "p", "B#b()", "b"), ("3", "p", "B#c()", "b")], "id string, project_id string, qualified_name string, file_path string")
    e = spark.createDataFrame([("1", "2", "CALLS"), ("1", "3", "CALLS"), ("2", "1", "CALLS")], "src string, dst string, kind string")
    new = spark.createDataFrame([("2", "p", "B#b()", "b")], "id string, project_id string, qualified_name string, file_path string")
    raw = spark.createDataFrame([("2", "B#b()", "CALLS", "b", 1, 1)], "source_id string, target_ref string, kind string, file_path string, source_line int, seq long")
    kept, links = index.replace_files(u, e, spark.createDataFrame([("p", "b")], "project_id string, file_path string"), new, raw)
    assert sorted(r["id"] for r in kept.collect()) == ["1", "2"] and sorted((r["src"], r["dst"]) for r in links.collect()) == [("1", "2"), ("2", "2")]


def test_exports(spark):
    e = spark.createDataFrame([("a.b", "a.c", 2)], "src string, dst string, n long")
    lines = lambda df: [r["line"] for r in df.collect()]
    red = spark.createDataFrame([("a.b",)], "id string")
    assert lines(exports.dot(e, red)) == ["digraph packages {", '  "a.b" [color=red];', '  "a.c";', '  "a.b" -> "a.c" [label=2];', "}"]
    assert lines(exports.mermaid(e, red)) == ["graph LR", "  a_b[a.b]", "  a_c[a.c]", "  a_b -->|2| a_c", "  style a_b fill:#f66"]
    v = spark.createDataFrame([("TRUE_RISK", 0.9, "f", "r", "a.py", 3)], "verdict string, confidence double, finding_id string, rule_id string, file_path string, line int")
    assert "\n".join(lines(exports.markdown(v))) == "# Findings\n\n- TRUE_RISK: 1\n- NEEDS_REVIEW: 0\n- LIKELY_FALSE_POSITIVE: 0\n\n## f TRUE_RISK (0.90)\n\nr at `a.py:3`"
    rules_ = spark.createDataFrame([("r", ["b", "a"], ["s"])], "rule_id string, sources array<string>, sinks array<string>")
    assert json.loads(exports.source_sink_rules(rules_).first()["document"]) == {"id": "r", "sources": ["a", "b"], "sinks": ["s"]}


def test_states_as_a_stream(spark, tmp_path):
    spark.createDataFrame([("e", 1, "claim"), ("e", 2, "claim"), ("e", 3, "confirm"), ("f", 1, "confirm")], "entry string, seq long, action string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entry string, seq long, action string").parquet(str(tmp_path / "in"))
    q = feed.states(stream, "entry", findings.REVIEW, "PENDING").writeStream.outputMode("update").format("memory").queryName("states").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r["entry"], r["state"], r["changes"]) for r in spark.table("states").collect()} == {("e", "CONFIRMED", 2), ("f", "PENDING", 0)}


def test_bursts_as_a_stream(spark, tmp_path):
    rows = [("p", 0), ("p", 2), ("p", 10), ("p", 100)]
    spark.createDataFrame(rows, "project_id string, t long").select("project_id", F.timestamp_seconds("t").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("project_id string, ts timestamp").parquet(str(tmp_path / "in"))
    q = feed.bursts(stream, "3 seconds", "1 second").writeStream.outputMode("append").format("memory").queryName("bursts").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r["changes"] for r in spark.table("bursts").collect()) == [1, 2]


def test_python_taint_summaries(spark):
    src = "def f(self, a, b):\n    x = a + 1\n    y = x\n    db.execute(y, 2)\n    go(b)\n    return y\n"
    u = spark.createDataFrame([("m", "python", src), ("n", "java", src), ("bad", "python", "def (")], "qualified_name string, language string, raw_source string")
    got = {tuple(r) for r in flows.summaries(u).collect()}
    assert got == {("m", 0, "RETURN", None, None), ("m", 0, "SINK", "execute", 0), ("m", 1, "CALL_ARG", "go", 0)}


def test_python_control_flow():
    src = "def f(a):\n    while a:\n        if b:\n            break\n        else:\n            continue\n    try:\n        g()\n    except E:\n        return 1\n    h()\n    return 2\n    dead()\n"
    edges = flows.cfg_of("m", src)
    label = {a: (text, line) for _, a, _, _, text, line in edges}
    named = {(label[a][0], label.get(b, ("EXIT", 0))[0], kind) for _, a, b, kind, *_ in edges}
    assert named == {
        ("ENTRY", "while a:", "NEXT"), ("while a:", "if b:", "TRUE"), ("if b:", "break", "TRUE"), ("if b:", "continue", "FALSE"), ("continue", "while a:", "CONTINUE"), ("break", "try:", "BREAK"),
        ("while a:", "try:", "FALSE"), ("try:", "g()", "NEXT"), ("try:", "return 1", "EXCEPTION"), ("g()", "h()", "NEXT"), ("return 1", "EXIT", "RETURN"), ("h()", "return 2", "NEXT"), ("return 2", "EXIT", "RETURN"),
    }


JAVA_METHOD = """@Override
public String run(String name, int k) throws X {
    int n = k + 1, m = 0;
    String q = "a" + name;
    this.count += n;
    outer:
    for (int i = 0; i < n; i++) {
        if (q.isEmpty()) { continue outer; } else if (k > 2) break;
        m++;
    }
    do { go(q); } while (m < 3);
    switch (k) { case 1: case 2: a(); break; case 3: b(); default: c(); }
    switch (k) { case 4, 5 -> a2(); default -> { b2(); } }
    try (R r = open(name)) { db.executeQuery(q); return q; } catch (E e) { log(e); throw e; } finally { done(); }
    return this.last + m;
}"""


def test_java_control_flow():
    edges = flows.java_cfg("m", JAVA_METHOD, 10, 25)
    label = {a: text for _, a, _, _, text, _ in edges}
    got = [(label[a], label.get(b, "EXIT"), kind) for _, a, b, kind, *_ in edges]
    assert sorted(got) == sorted([
        ("ENTRY", "int n = k + 1, m = 0;", "NEXT"), ("int n = k + 1, m = 0;", 'String q = "a" + name;', "NEXT"), ('String q = "a" + name;', "this.count += n;", "NEXT"), ("this.count += n;", "int i = 0", "NEXT"), ("int i = 0", "i < n", "NEXT"),
        ("i < n", "q.isEmpty()", "TRUE_BRANCH"), ("q.isEmpty()", "continue outer;", "TRUE_BRANCH"), ("q.isEmpty()", "k > 2", "FALSE_BRANCH"), ("k > 2", "break;", "TRUE_BRANCH"), ("k > 2", "m++;", "FALSE_BRANCH"), ("m++;", "i++", "NEXT"),
        ("continue outer;", "i++", "NEXT"), ("i++", "i < n", "LOOP_BACK"), ("i < n", "go(q);", "FALSE_BRANCH"), ("break;", "go(q);", "NEXT"), ("go(q);", "m < 3", "NEXT"), ("m < 3", "go(q);", "TRUE_BRANCH"), ("m < 3", "switch (k)", "FALSE_BRANCH"),
        ("switch (k)", "a();", "CASE_BRANCH"), ("switch (k)", "a();", "CASE_BRANCH"), ("a();", "break;", "NEXT"), ("switch (k)", "b();", "CASE_BRANCH"), ("b();", "c();", "NEXT"), ("switch (k)", "c();", "FALSE_BRANCH"), ("break;", "switch (k)", "NEXT"),
        ("c();", "switch (k)", "NEXT"), ("switch (k)", "a2();", "CASE_BRANCH"), ("switch (k)", "a2();", "CASE_BRANCH"), ("switch (k)", "b2();", "FALSE_BRANCH"), ("a2();", "R r = open(name)", "NEXT"), ("b2();", "R r = open(name)", "NEXT"),
        ("R r = open(name)", "db.executeQuery(q);", "NEXT"), ("db.executeQuery(q);", "return q;", "NEXT"), ("db.executeQuery(q);", "catch (E e)", "EXCEPTION_BRANCH"), ("catch (E e)", "log(e);", "NEXT"), ("log(e);", "throw e;", "NEXT"),
        ("finally", "done();", "NEXT"), ("done();", "return this.last + m;", "NEXT"), ("return q;", "EXIT", "NEXT"), ("throw e;", "EXIT", "NEXT"), ("return this.last + m;", "EXIT", "NEXT"),
    ])
    assert {line for *_, line in edges} == {10, 12, 13, 14, 16, 17, 18, 20, 21, 22, 23, 24}


def test_java_dependences_and_summaries():
    data = {(a, b, s) for _, a, b, kind, s in flows.java_dependence("m", JAVA_METHOD, 10, 25) if kind == "DATA_DEPENDENCY"}
    assert {(0, 1, "k"), (0, 2, "name"), (1, 3, "n"), (4, 5, "i"), (1, 5, "n"), (2, 6, "q"), (0, 8, "k")} <= data and not any(s == "this" for *_, s in data)
    assert flows.java_data("m", JAVA_METHOD) == [("m", "name,k", "count,last", "count", "q,last,m")]
    assert {r[1:] for r in flows.java_summary("m", JAVA_METHOD)} == {(0, "CALL_ARG", "go", 0), (0, "CALL_ARG", "log", 0), (0, "CALL_ARG", "open", 0), (0, "RETURN", None, None), (0, "SINK", "executeQuery", 0)}
    for text in ("", "int x;", "void f(", "void f() { if (", "void f() { for (;;) { } }", "void f() { a = b ? c : d; try { } finally { } }", "}{"):
        for made in (flows.java_cfg, flows.java_dependence, flows.java_summary, flows.java_data):
            made("m", text)


def test_authorization(spark):
    methods = [("a", "/a", "@GetMapping,@Secured", "@DenyAll"), ("b", "/b", "", "@DenyAll"), ("c", "/c", "", ""), ("d", "/d", None, None)]
    m = spark.createDataFrame(methods, "id string, route string, annotations string, class_annotations string")
    p = spark.createDataFrame([("p2", 'match("/c").permit()'), ("p1", "x")], "policy_id string, text string")
    got = {r["id"]: (r["source"], r["constraint"]) for r in security.authorization(m, p).collect()}
    assert got == {"a": ("METHOD", "@Secured"), "b": ("CLASS", "@DenyAll"), "c": ("POLICY", "p2"), "d": ("NONE", "")}
    everywhere = spark.createDataFrame([("p0", "anyRequest().authenticated()")], "policy_id string, text string")
    assert {r["id"]: r["source"] for r in security.authorization(m, everywhere).collect()}["d"] == "POLICY"


def test_entry_siblings_and_pages(spark):
    u = spark.createDataFrame([("A", True), ("B", False)], "parent_qualified_name string, is_entry_point boolean")
    f = spark.createDataFrame([("x", "A"), ("y", "B")], "id string, parent_qualified_name string")
    assert [r["id"] for r in security.entry_siblings(f, u).collect()] == ["x"]
    facts = spark.createDataFrame([("p", 1, 0, 2, 3, "K")], "package string, units long, entry_points long, inbound long, outbound long, key_symbols string")
    assert exports.package_pages(facts).first()["page"].startswith("# p\n\n- units: 1")
