"""Control flow, dependences and taint of one Java method, from its source text.

The body is read into statements on the tokens of ``java.Reader``; a graph is drawn over them whose nodes are single
statements and conditions.  What follows a return, throw, break or continue in its block is left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from graphlens.sources.java import PRIMITIVES, Reader

LABEL = 160
Ends = list[tuple[int, str]]


@dataclass
class Statement:
    kind: str
    a: int
    b: int
    head: tuple[int, int] = (0, 0)
    blocks: list[list[Statement]] = field(default_factory=list)
    heads: list[tuple[int, int]] = field(default_factory=list)
    label: str = ""
    entries: list[tuple[int, bool, bool, list[Statement]]] = field(default_factory=list)


class Method:
    """The parameters and statements of the method in a source text."""

    def __init__(self, source: str):
        self.source = source
        self.reader = Reader(source, "", lambda kind, name: name)
        self.at = self.reader.offsets
        self.text, self.line = self.reader.text, lambda i: self.reader.tokens[min(i, len(self.at) - 1)][2]
        i = 0
        while self.text(i) and not (self.reader.is_name(i) and self.text(i + 1) == "("):
            i = self.reader.mark(i)[1] if self.text(i) == "@" and self.reader.is_name(i + 1) else i + 1
        self.parameters = [n for _, n, _ in self.reader.parameters(i + 1)] if self.text(i) else []
        i = self.reader.after(i + 1) if self.text(i) else i
        while self.text(i) not in ("{", ";", ""):
            i += 1
        self.first, self.last = i, (self.reader.after(i) if self.text(i) == "{" else i) - 1
        self.statements = self.block(i + 1, self.last) if self.text(i) == "{" else None

    # statements ----------------------------------------------------------------------------------------------------

    def block(self, i: int, end: int) -> list[Statement]:
        out = []
        while i < end:
            s = self.statement(i, end)
            if s.kind != "empty":
                out.append(s)
            i = max(s.b, i + 1)
        return out

    def end_of(self, i: int) -> int:
        """The place after the semicolon that ends what starts at ``i``."""
        while self.text(i) not in (";", ""):
            i = self.reader.after(i) if self.text(i) in ("(", "[", "{") else i + 1
        return i + 1

    def branch(self, i: int, end: int) -> tuple[list[Statement], int]:
        s = self.statement(i, end)
        return (s.blocks[0] if s.kind == "block" else [s] if s.kind != "empty" else []), s.b

    def statement(self, i: int, end: int) -> Statement:
        t = self.text(i)
        r = self.reader
        if t == "{":
            stop = r.after(i)
            return Statement("block", i, stop, blocks=[self.block(i + 1, stop - 1)])
        if t == ";":
            return Statement("empty", i, i + 1)
        if r.is_name(i) and self.text(i + 1) == ":" and self.text(i + 2) != ":":
            s = self.statement(i + 2, end)
            s.label = t
            return s
        if t in ("if", "while", "for", "switch") and self.text(i + 1) == "(":
            stop = r.after(i + 1)
            s = Statement(t, i, stop, (i + 2, stop - 1))
            if t == "switch":
                s.b = r.after(stop)
                s.entries = self.entries(stop + 1, s.b - 1)
                return s
            body, s.b = self.branch(stop, end)
            s.blocks = [body]
            if t == "if" and self.text(s.b) == "else":
                other, s.b = self.branch(s.b + 1, end)
                s.blocks.append(other)
            if t == "for":
                self.header(s)
            return s
        if t == "do":
            body, stop = self.branch(i + 1, end)
            close = r.after(stop + 1)
            return Statement("do", i, close + 1, (stop + 2, close - 1), [body])
        if t == "try":
            return self.trial(i, end)
        if t in ("return", "throw", "break", "continue"):
            stop = self.end_of(i)
            return Statement(t, i, stop, (i + 1, stop - 1))
        if t == "synchronized" and self.text(i + 1) == "(":
            return Statement("plain", i, r.after(r.after(i + 1)))
        j = i
        while self.text(j) in ("final", "abstract", "static") or self.text(j) == "@":
            j = r.mark(j)[1] if self.text(j) == "@" else j + 1
        if self.text(j) in ("class", "interface", "enum") or (self.text(j) == "record" and r.is_name(j + 1) and self.text(j + 2) == "("):
            while self.text(j) not in ("{", ""):
                j += 1
            return Statement("plain", i, r.after(j))
        return Statement("plain", i, self.end_of(i))

    def header(self, s: Statement) -> None:
        """The parts of a ``for``: a condition alone (each element), or start, condition and steps."""
        cuts, i = [s.head[0]], s.head[0]
        while i < s.head[1]:
            if self.text(i) == ";":
                cuts.append(i + 1)
            i = self.reader.after(i) if self.text(i) in ("(", "[", "{") else i + 1
        if len(cuts) < 3:
            at = next((k for k in range(*s.head) if self.text(k) == ":"), s.head[0] - 1)
            s.kind, s.heads, s.head = "each", [(s.head[0], at)], (at + 1, s.head[1])
            return
        whole = s.head[1]
        s.heads = [(cuts[0], cuts[1] - 1), (cuts[2], whole)]
        s.head = (cuts[1], cuts[2] - 1)

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """The expressions between commas; a declaration is one."""
        if a >= b or self.declared(a):
            return [(a, b)] if a < b else []
        out = []
        while a < b:
            stop = min(self.reader.expression_end(a), b)
            out.append((a, stop))
            a = stop + 1
        return out

    def declared(self, i: int) -> bool:
        found = self.reader.kind_at(i + (self.text(i) == "final"))
        return found is not None and self.reader.is_name(found[1])

    def entries(self, i: int, end: int) -> list[tuple[int, bool, bool, list[Statement]]]:
        """(number of labels, default, arrow, statements) of the cases of a switch."""
        out = []
        while i < end:
            if self.text(i) not in ("case", "default"):
                i += 1
                continue
            default, labels, j = self.text(i) == "default", 0, i + 1
            if not default:
                labels = 1
                while self.text(j) not in (":", "->", ""):
                    labels += self.text(j) == ","
                    j = self.reader.after(j) if self.text(j) in ("(", "[", "{") else j + 1
            arrow = self.text(j) == "->"
            j += 1
            if arrow:
                s = self.statement(j, end)
                body, j = (s.blocks[0] if s.kind == "block" else [s]), s.b
            else:
                stop = j
                while stop < end and not (self.text(stop) in ("case", "default")):
                    stop = self.reader.after(stop) if self.text(stop) in ("(", "[", "{") else stop + 1
                body, j = self.block(j, stop), stop
            out.append((labels, default, arrow, body))
            i = j
        return out

    def trial(self, i: int, end: int) -> Statement:
        s, j = Statement("try", i, i + 1), i + 1
        if self.text(j) == "(":
            stop, a = self.reader.after(j), j + 1
            while a < stop - 1:
                b = a
                while b < stop - 1 and self.text(b) != ";":
                    b = self.reader.after(b) if self.text(b) in ("(", "[", "{") else b + 1
                if a < b:
                    s.heads.append((a, b))
                a = b + 1
            j = stop
        stop = self.reader.after(j)
        s.blocks, s.head = [self.block(j + 1, stop - 1)], (j, stop)
        j = stop
        while self.text(j) == "catch":
            stop = self.reader.after(j + 1)
            close = self.reader.after(stop)
            s.entries.append((j, False, False, self.block(stop + 1, close - 1)))
            j = close
        if self.text(j) == "finally":
            close = self.reader.after(j + 1)
            s.blocks.append(self.block(j + 2, close - 1))
            s.label = f"{s.label}\x00{j}"
            j = close
        s.b = j
        return s

    # names ---------------------------------------------------------------------------------------------------------

    def shown(self, a: int, b: int) -> str:
        b = min(b, len(self.at))
        if a >= b:
            return ""
        text = " ".join(self.source[self.at[a] : self.at[b - 1] + len(self.text(b - 1))].split())
        return text if len(text) <= LABEL else text[: LABEL - 3] + "..."

    def assigned(self, i: int) -> str:
        """``=`` if a value is given to what ends before ``i``, ``+=`` if it changes it, else nothing."""
        t, n, m = self.text(i), self.text(i + 1), self.text(i + 2)
        if t == "=" and n != "=" and self.text(i - 1) not in ("=", "!", "<", ">"):
            return "="
        if (t in "+-*/%&|^" and t and n == "=" and m != "=") or (t in ("<", ">") and n == t and (m == "=" or (m == t and self.text(i + 3) == "="))):
            return "+="
        return "+=" if t in ("+", "-") and n == t else ""

    def facts(self, a: int, b: int) -> tuple[list[str], list[str], list[tuple[str, str]]]:
        """Defined names, used names, and (field, how) of fields of ``this`` between ``a`` and ``b``."""
        r, defs, uses, fields, i = self.reader, [], [], [], a
        fresh = True
        while i < b:
            t = self.text(i)
            before = self.text(i - 1) if i > a else ""
            if fresh and t == "final":
                i += 1
                continue
            found = r.kind_at(i) if (r.is_name(i) or t in PRIMITIVES) and before not in (".", "new", "::") else None
            if found and r.is_name(found[1]) and self.text(found[1] + 1) in ("=", ";", ":", ",", ")", "") or (found and r.is_name(found[1]) and found[1] + 1 >= b):
                i = found[1]
                defs.append(self.text(i))
                i += 1
                while self.text(i) == "," and i < b and r.is_name(i + 1) and self.text(i + 2) in ("=", ",", ";") and fresh:
                    defs.append(self.text(i + 1))
                    i += 2
                continue
            if t == "new" and (made := r.kind_at(i + 1)):
                i = made[1]
                continue
            if t == "(" and (made := r.kind_at(i + 1)) and self.text(made[1]) == ")" and r.casts(made[1] + 1) and (made[0] in PRIMITIVES or self.text(made[1] + 1) not in ("(", "")) and not (r.is_name(i - 1) or before in (")", "]")):
                i = made[1] + 1
                continue
            if t == "this" and self.text(i + 1) == "." and r.is_name(i + 2) and self.text(i + 3) != "(":
                how = self.assigned(i + 3) if i + 3 < b else ""
                if not how and (self.text(i - 2), before) in (("+", "+"), ("-", "-")):
                    how = "+="
                fields.append((self.text(i + 2), how))
                uses.append(self.text(i + 2))
                if how:
                    defs.append(self.text(i + 2))
                i += 3
                continue
            if r.is_name(i) and before not in (".", "::", "@") and self.text(i + 1) not in ("(", "->") and not (before == "instanceof"):
                how = self.assigned(i + 1) if i + 1 < b else ""
                if how or (self.text(i - 2), before) in (("+", "+"), ("-", "-")):
                    defs.append(t)
                uses.append(t)
            fresh = t in ("{", ";", "(", "}")
            i += 1
        return list(dict.fromkeys(defs)), list(dict.fromkeys(uses)), fields


class Flow:
    """Nodes (kind, label, line), edges (source, target, kind, symbol) of control, and of dependence, of a method."""

    def __init__(self, method: Method, start: int = 1, end: int = 0):
        self.m, self.start = method, start
        self.nodes: list[tuple[str, str, int]] = []
        self.control: list[tuple[int, int, str, str]] = []
        self.dependence: list[tuple[int, int, str, str]] = []
        self.defined: dict[str, int] = {}
        self.jumps: list[dict] = []
        self.over: list[int] = []
        entry = self.node("ENTRY", "ENTRY", start)
        self.defined = dict.fromkeys(method.parameters, entry)
        ends = self.run(method.statements or [], [(entry, "NEXT")])
        last = self.node("EXIT", "EXIT", max(start, end))
        self.join(ends, last)
        self.join([(n, "NEXT") for n in self.over], last)

    def node(self, kind: str, label: str, line: int) -> int:
        self.nodes.append((kind, label, line))
        return len(self.nodes) - 1

    def join(self, ends: Ends, to: int, kind: str | None = None) -> None:
        self.control += [(a, to, kind or k, "") for a, k in ends]

    def place(self, kind: str, a: int, b: int, ends: Ends, line_at: int | None = None, label: str | None = None, span: tuple[int, int] | None = None) -> int:
        """A node for the tokens between ``a`` and ``b``, behind ``ends``, with what it depends on."""
        n = self.node(kind, self.m.shown(a, b) if label is None else label, self.start + self.m.line(a if line_at is None else line_at) - 1)
        self.join(ends, n)
        defs, uses, _ = self.m.facts(*(span or (a, b)))
        for name in uses:
            if name not in defs and self.defined.get(name, n) != n:
                self.dependence.append((self.defined[name], n, "DATA_DEPENDENCY", name))
        self.defined |= dict.fromkeys(defs, n)
        return n

    def under(self, condition: int, first: int, end: int | None = None) -> None:
        self.dependence += [(condition, n, "CONTROL_DEPENDENCY", "") for n in range(first, len(self.nodes) if end is None else end)]

    def run(self, statements: list[Statement], ends: Ends) -> Ends:
        for s in statements:
            if not ends:
                break
            ends = getattr(self, f"_{s.kind}", self._plain)(s, ends)
        return ends

    def _plain(self, s: Statement, ends: Ends) -> Ends:
        return [(self.place("STATEMENT", s.a, s.b, ends), "NEXT")]

    def _block(self, s: Statement, ends: Ends) -> Ends:
        return self.run(s.blocks[0], ends)

    def _return(self, s: Statement, ends: Ends) -> Ends:
        self.over.append(self.place("RETURN" if s.kind == "return" else "THROW", s.a, s.b, ends))
        return []

    _throw = _return

    def _jump(self, s: Statement, ends: Ends) -> Ends:
        n, to = self.place("STATEMENT", s.a, s.b, ends, span=(s.a, s.a)), self.m.text(s.head[0]) if s.head[0] < s.head[1] else ""
        fits = [j for j in reversed(self.jumps) if (j["label"] == to if to else s.kind == "break" or not j["switch"])]
        if not fits:
            return [(n, "NEXT")]
        fits[0][s.kind].append((n, "NEXT"))
        return []

    _break = _continue = _jump

    def inside(self, s: Statement, body: list[Statement], ends: Ends, switch: bool = False) -> tuple[Ends, dict]:
        """The ends of a body that can be left early, and the jumps out of it."""
        self.jumps.append({"label": s.label.partition("\x00")[0] or None, "switch": switch, "break": [], "continue": []})
        ends = self.run(body, ends)
        return ends, self.jumps.pop()

    def _if(self, s: Statement, ends: Ends) -> Ends:
        n = self.place("CONDITION", *s.head, ends, s.a)
        out: Ends = []
        for body, kind in zip(s.blocks, ("TRUE_BRANCH", "FALSE_BRANCH")):
            first = len(self.nodes)
            out += self.run(body, [(n, kind)])
            self.under(n, first)
        return out if len(s.blocks) > 1 else [*out, (n, "FALSE_BRANCH")]

    def _while(self, s: Statement, ends: Ends) -> Ends:
        n = self.place("CONDITION", *s.head, ends, s.a)
        first = len(self.nodes)
        back, jumps = self.inside(s, s.blocks[0], [(n, "TRUE_BRANCH")])
        self.under(n, first)
        self.join(back + jumps["continue"], n, "LOOP_BACK")
        return [(n, "FALSE_BRANCH"), *jumps["break"]]

    _each = _while

    def _for(self, s: Statement, ends: Ends) -> Ends:
        for a, b in self.m.split(*s.heads[0]):
            ends = [(self.place("STATEMENT", a, b, ends), "NEXT")]
        n = self.place("CONDITION", *s.head, ends, s.a, "true" if s.head[0] >= s.head[1] else None)
        first = len(self.nodes)
        back, jumps = self.inside(s, s.blocks[0], [(n, "TRUE_BRANCH")])
        self.under(n, first)
        back = back + jumps["continue"]
        for a, b in self.m.split(*s.heads[1]):
            back = [(self.place("STATEMENT", a, b, back), "NEXT")]
        self.join(back, n, "LOOP_BACK")
        return [(n, "FALSE_BRANCH"), *jumps["break"]]

    def _do(self, s: Statement, ends: Ends) -> Ends:
        first = len(self.nodes)
        back, jumps = self.inside(s, s.blocks[0], ends)
        n = self.place("CONDITION", *s.head, back + jumps["continue"])
        self.control.append((n, first, "TRUE_BRANCH", ""))
        self.under(n, first, n)
        return [(n, "FALSE_BRANCH"), *jumps["break"]]

    def _switch(self, s: Statement, ends: Ends) -> Ends:
        n = self.place("CONDITION", *s.head, ends, s.a, f"switch ({self.m.shown(*s.head)})")
        self.jumps.append({"label": s.label or None, "switch": True, "break": [], "continue": []})
        through: Ends = []
        for labels, default, arrow, body in s.entries:
            into = [*through, *([(n, "FALSE_BRANCH")] if default else [(n, "CASE_BRANCH")] * labels)]
            through = self.run(body, into) if body else into
            if arrow:
                self.jumps[-1]["break"] += through
                through = []
        out = self.jumps.pop()["break"] + through
        return out if any(d for _, d, _, _ in s.entries) else [*out, (n, "FALSE_BRANCH")]

    def _try(self, s: Statement, ends: Ends) -> Ends:
        for a, b in s.heads:
            ends = [(self.place("STATEMENT", a, b, ends), "NEXT")]
        first = len(self.nodes)
        out = self.run(s.blocks[0], ends)
        some = len(self.nodes) > first
        for j, _, _, body in s.entries:
            stop = self.m.reader.after(j + 1)
            n = self.node("CATCH", f"catch ({self.m.shown(j + 2, stop - 1)})", self.start + self.m.line(j) - 1)
            if some:
                self.control.append((first, n, "EXCEPTION_BRANCH", ""))
            out = out + self.run(body, [(n, "NEXT")])
        if len(s.blocks) > 1:
            n = self.node("FINALLY", "finally", self.start + self.m.line(int(s.label.partition("\x00")[2]) + 1) - 1)
            self.join(out, n)
            return self.run(s.blocks[1], [(n, "NEXT")])
        return out


def _returns(method: Method) -> list[tuple[int, int]]:
    return [(i + 1, method.end_of(i) - 1) for i in range(method.first, method.last) if method.text(i) == "return"]


def data_summary(method: Method) -> tuple[list[str], list[str], list[str], list[str]]:
    """Parameters, fields read and written through ``this``, and names that results come from."""
    _, _, fields = method.facts(method.first + 1, method.last)
    sources = dict.fromkeys(name for a, b in _returns(method) for name in method.facts(a, b)[1])
    return method.parameters, list(dict.fromkeys(f for f, how in fields if how != "=")), list(dict.fromkeys(f for f, how in fields if how)), list(sources)


def taint_summary(method: Method, sinks: tuple[str, ...]) -> list[tuple[int, str, str | None, int | None]]:
    """(parameter, RETURN | CALL_ARG | SINK, callee, argument) without regard to the order of statements."""
    r = method.reader
    taint: dict[str, set[int]] = {p: {k} for k, p in enumerate(method.parameters)}
    names = lambda a, b: [n for n in method.facts(a, b)[1] if n in taint]
    of = lambda a, b: set().union(*(taint[n] for n in names(a, b)))
    given: list[tuple[str, int, int]] = []
    calls: list[tuple[str, int, int, int]] = []
    caught: list[tuple[str, int, int]] = []
    for i in range(method.first + 1, method.last):
        if r.is_name(i) and method.text(i - 1) != "." and method.assigned(i + 1) and not (method.text(i + 1) in "+-" and method.text(i + 2) == method.text(i + 1)):
            given.append((method.text(i), i + 2, min(r.expression_end(i + 2), method.last)))
        if r.is_name(i) and method.text(i + 1) == "(" and method.text(i - 1) != "new" and r.kind_at(i) is not None:
            end, a, k = r.after(i + 1) - 1, i + 2, 0
            while a < end:
                b = min(r.expression_end(a), end)
                calls.append((method.text(i), k, a, b))
                a, k = b + 1, k + 1
        if method.text(i) == "catch" and method.text(i + 1) == "(":
            owner = _try_block(method, i)
            caught.append((method.text(r.after(i + 1) - 2), *owner))
    changed = True
    while changed:
        changed = False
        for name, a, b in [*given, *caught]:
            new = of(a, b)
            if new - taint.get(name, set()):
                taint.setdefault(name, set()).update(new)
                changed = True
    out: list[tuple[int, str, str | None, int | None]] = [(p, "RETURN", None, None) for a, b in _returns(method) for p in of(a, b)]
    out += [(p, "SINK" if name in sinks else "CALL_ARG", name, k) for name, k, a, b in calls for p in of(a, b)]
    return sorted(set(out), key=repr)


def _try_block(method: Method, i: int) -> tuple[int, int]:
    """The block of the ``try`` that the ``catch`` at ``i`` belongs to."""
    depth, j = 0, i - 1
    while j > method.first:
        depth += (method.text(j) in (")", "}")) - (method.text(j) in ("(", "{"))
        if depth == 0 and method.text(j) == "try":
            at = j + 1
            while method.text(at) == "(":
                at = method.reader.after(at)
            return at + 1, method.reader.after(at) - 1
        j -= 1
    return i, i


def clean(source: str | None) -> str:
    return re.sub(r"\r\n?", "\n", source or "")
