"""Control flow, dependences and taint summaries of Python functions, by the standard library's parser, and of Java methods, on tokens.

Units have columns language, qualified_name and raw_source, perhaps kind, start_line and end_line; those of other languages
and kinds, and sources that can't be read, give nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.sources.read import read

#: Methods that count as sinks.
SINKS = (
    "executeQuery", "executeUpdate", "execute", "executeBatch", "executeLargeUpdate", "exec", "start", "readObject", "readUnshared", "deserialize", "loadClass", "forName",
    "write", "print", "println", "sendRedirect", "sendError", "invoke", "newInstance", "lookup", "search", "parse",
)

SUMMARY = "method string, from_param int, kind string, callee string, to_index int"
CFG = "method string, src int, dst int, kind string, src_label string, src_line int"
LABEL = 160


def _function(source: str):
    import ast
    import textwrap

    try:
        tree = ast.parse(textwrap.dedent(source or ""))
    except (SyntaxError, ValueError):
        return None
    return next((n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)), None)


def summary_of(method: str, source: str) -> list[tuple]:
    """Flows from parameters to the result, to arguments of calls and to sinks, without regard to order."""
    import ast

    f = _function(source)
    if f is None:
        return []
    params = [a.arg for a in f.args.args if a.arg not in ("self", "cls")]
    taint = {p: {i} for i, p in enumerate(params)}
    of = lambda node: set().union(*[taint.get(n.id, set()) for n in ast.walk(node) if isinstance(n, ast.Name)], set()) if node else set()
    pairs = []
    for n in ast.walk(f):
        if isinstance(n, ast.Assign):
            pairs += [(t, n.value) for t in n.targets]
        elif isinstance(n, ast.AnnAssign | ast.AugAssign | ast.NamedExpr):
            pairs.append((n.target, n.value))
        elif isinstance(n, ast.For | ast.AsyncFor):
            pairs.append((n.target, n.iter))
        elif isinstance(n, ast.withitem) and n.optional_vars:
            pairs.append((n.optional_vars, n.context_expr))
    changed = True
    while changed:
        changed = False
        for target, value in pairs:
            new = of(value)
            for name in (x.id for x in ast.walk(target) if isinstance(x, ast.Name)):
                if not new <= taint.setdefault(name, set()):
                    taint[name] |= new
                    changed = True
    out = {(method, p, "RETURN", None, None) for n in ast.walk(f) if isinstance(n, ast.Return) for p in of(n.value)}
    for call in (n for n in ast.walk(f) if isinstance(n, ast.Call)):
        name = call.func.attr if isinstance(call.func, ast.Attribute) else getattr(call.func, "id", "")
        for j, arg in enumerate(call.args):
            out |= {(method, p, "SINK" if name in SINKS else "CALL_ARG", name, j) for p in of(arg) if name}
    return sorted(out, key=repr)


def cfg_of(method: str, source: str) -> list[tuple]:
    """Edges of the statement graph: ENTRY is 0, EXIT is 1; what follows a return, raise, break or continue is left out."""
    import ast

    f = _function(source)
    if f is None:
        return []
    labels: dict[int, tuple[str, int]] = {0: ("ENTRY", f.lineno), 1: ("EXIT", f.end_lineno or f.lineno)}
    edges: list[tuple[int, int, str]] = []

    def node(stmt, text: str) -> int:
        labels[len(labels)] = (text[:LABEL], stmt.lineno)
        return len(labels) - 1

    def link(ends, to: int) -> None:
        edges.extend((a, to, kind) for a, kind in ends)

    def block(stmts, ends, loop):
        """Ends after ``stmts``; ``loop``: (head, list of breaks)."""
        for s in stmts:
            if not ends:
                break
            text = ast.unparse(s).split("\n")[0]
            n = node(s, text)
            link(ends, n)
            if isinstance(s, ast.If):
                ends = block(s.body, [(n, "TRUE")], loop) + (block(s.orelse, [(n, "FALSE")], loop) if s.orelse else [(n, "FALSE")])
            elif isinstance(s, ast.While | ast.For | ast.AsyncFor):
                breaks: list = []
                link(block(s.body, [(n, "TRUE")], (n, breaks)), n)
                ends = (block(s.orelse, [(n, "FALSE")], loop) if s.orelse else [(n, "FALSE")]) + breaks
            elif isinstance(s, ast.Try):
                body = block(s.body, [(n, "NEXT")], loop)
                rest = block(s.orelse, body, loop) if s.orelse else body
                for h in s.handlers:
                    rest = rest + block(h.body, [(n, "EXCEPTION")], loop)
                ends = block(s.finalbody, rest, loop) if s.finalbody else rest
            elif isinstance(s, ast.With | ast.AsyncWith):
                ends = block(s.body, [(n, "NEXT")], loop)
            elif isinstance(s, ast.Return | ast.Raise):
                edges.append((n, 1, "RETURN" if isinstance(s, ast.Return) else "EXCEPTION"))
                ends = []
            elif isinstance(s, ast.Break) and loop:
                loop[1].append((n, "BREAK"))
                ends = []
            elif isinstance(s, ast.Continue) and loop:
                edges.append((n, loop[0], "CONTINUE"))
                ends = []
            else:
                ends = [(n, "NEXT")]
        return ends

    link(block(f.body, [(0, "NEXT")], None), 1)
    return [(method, a, b, kind, *labels[a]) for a, b, kind in edges]


DEPENDENCE = "method string, src int, dst int, kind string, symbol string"
DATA = "method string, parameters string, fields_read string, fields_written string, return_sources string"


def _method(source: str):
    from graphlens.sources.java_flow import Method, clean

    found = Method(clean(source))
    return found if found.statements is not None else None


def _java_flow(source: str, start: int, end: int):
    from graphlens.sources.java_flow import Flow

    m = _method(source)
    return Flow(m, start, end) if m else None


def java_cfg(method: str, source: str, start: int = 1, end: int = 0) -> list[tuple]:
    """Edges of control of a Java method; ENTRY is 0, EXIT is the last."""
    f = _java_flow(source, start, end)
    return [(method, a, b, kind, *f.nodes[a][1:]) for a, b, kind, _ in f.control] if f else []


def java_dependence(method: str, source: str, start: int = 1, end: int = 0) -> list[tuple]:
    f = _java_flow(source, start, end)
    return [(method, a, b, kind, symbol) for a, b, kind, symbol in f.dependence] if f else []


def java_summary(method: str, source: str, start: int = 1, end: int = 0) -> list[tuple]:
    from graphlens.sources.java_flow import taint_summary

    m = _method(source)
    return [(method, p, kind, callee, k) for p, kind, callee, k in taint_summary(m, SINKS)] if m else []


def java_data(method: str, source: str, start: int = 1, end: int = 0) -> list[tuple]:
    from graphlens.sources.java_flow import data_summary

    m = _method(source)
    return [(method, *(",".join(x) for x in data_summary(m)))] if m else []


#: What reads the functions of a language.
READERS = {
    "cfg": {"python": lambda q, s, a, b: cfg_of(q, s), "java": java_cfg, "c": java_cfg},
    "summary": {"python": lambda q, s, a, b: summary_of(q, s), "java": java_summary},
    "dependence": {"java": java_dependence},
    "data": {"java": java_data},
}


def _rows(units: DataFrame, what: str, schema: str) -> DataFrame:
    made = READERS[what]
    own = units.filter(F.col("language").isin(*made))
    if "kind" in units.columns:
        own = own.filter(F.col("kind").isin("METHOD", "CONSTRUCTOR", "FUNCTION"))
    line = lambda c: F.coalesce(c, F.lit(1)).cast("int") if c in units.columns else F.lit(1)

    def rows(language: str, name: str, source: str, a: int, b: int) -> list[tuple]:
        return made[language](name, source, a, b)

    texts = own.select("language", "qualified_name", F.coalesce("raw_source", F.lit("")).alias("raw_source"), line("start_line").alias("a"), line("end_line").alias("b"))
    return read(texts, "raw_source", ["qualified_name", "raw_source"], rows, schema)


def summaries(units: DataFrame) -> DataFrame:
    """Taint summaries (method, from_param, kind, callee, to_index) of Python and Java units."""
    return _rows(units, "summary", SUMMARY)


def control_flow(units: DataFrame) -> DataFrame:
    """Control-flow edges (method, src, dst, kind, src_label, src_line) of Python, Java and C units."""
    return _rows(units, "cfg", CFG)


def dependences(units: DataFrame) -> DataFrame:
    """Edges of data and control dependence (method, src, dst, kind, symbol) of Java units, between the nodes of their control flow."""
    return _rows(units, "dependence", DEPENDENCE)


def data_summaries(units: DataFrame) -> DataFrame:
    """Parameters, fields of ``this`` that are read and written, and names that results come from (comma-joined) of Java units."""
    return _rows(units, "data", DATA)
