"""A reader of Java sources on tokens: declarations with their relations, without a compiler.

Types, methods, constructors and fields become units; what they contain, extend, implement, override, use as a type and
call becomes relations.  A call names its target as well as one file tells: the only fitting method of the same file,
else the receiver's type, the name, and the types of the arguments where all are known, or their number.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

#: Annotations of entries and tests, and interfaces whose methods a framework calls.
ENTRIES = ("@RestController", "@Controller", "@GetMapping", "@PostMapping", "@PutMapping", "@PatchMapping", "@DeleteMapping", "@RequestMapping", "@Path", "@GET", "@POST", "@PUT", "@DELETE")
TESTS = ("@Test", "@ParameterizedTest", "@RepeatedTest")
CALLBACKS = (
    "Filter", "HandlerInterceptor", "AuthenticationProvider", "AuthenticationEntryPoint", "AuthenticationFailureHandler", "AuthenticationSuccessHandler", "AccessDeniedHandler",
    "LogoutHandler", "LogoutSuccessHandler", "UserDetailsService", "AuthenticationManager", "ContainerRequestFilter", "ContainerResponseFilter", "ExceptionMapper",
)

TOKEN = re.compile(
    r'(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*")|(?P<char>\'(?:\\.|[^\'\\\n])+\')'
    r"|(?P<number>0[xXbB][\da-fA-F_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDlL]?)|(?P<name>[^\W\d][\w$]*)|(?P<sign>->|::|\.\.\.|.)",
    re.S,
)
PRIMITIVES = frozenset(("int", "long", "short", "byte", "char", "boolean", "float", "double"))
MODIFIERS = frozenset(("public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed", "non-sealed"))
TYPES = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "CLASS", "@interface": "ANNOTATION"}
WORDS = frozenset(
    "if else for while do switch case return throw try catch finally new instanceof break continue synchronized assert yield this super void import package class interface enum extends implements throws null true false goto const".split()
)
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


@dataclass
class Unit:
    kind: str
    name: str
    simple: str
    start: int
    end: int
    signature: str
    marks: list[str]
    parent: str | None
    entry: bool = False
    test: bool = False


@dataclass
class Relation:
    source: str
    target: str
    kind: str
    line: int


@dataclass
class Scope:
    """Where a piece of code stands, and what the variables of its member are, with and without their package."""

    owner: str
    member: str | None = None
    listed: bool = False
    variables: dict[str, str] = field(default_factory=dict)
    values: dict[str, str] = field(default_factory=dict)


def plain(kind: str) -> str:
    """A type without its parameters."""
    return re.sub(r"<.*>", "", kind) if "<" in kind else kind


class Reader:
    def __init__(self, source: str, path: str, ident):
        """``ident`` gives the id of a unit from its kind and qualified name."""
        self.path, self.ident = path, ident
        self.tokens: list[tuple[str, str, int]] = []
        self.offsets: list[int] = []
        line = 1
        tokens, offsets = self.tokens, self.offsets
        for m in TOKEN.finditer(source):
            kind = m.lastgroup
            if kind == "skip":
                line += m[0].count("\n")
                continue
            tokens.append((kind, m[0], line))
            offsets.append(m.start())
            if kind == "text":
                line += m[0].count("\n")
        self.tokens += [("end", "", line)] * 3
        self.offsets += [len(source)] * 3
        self.words, self.n = [t[1] for t in self.tokens], len(self.tokens)
        #: By the place of a bracket, the place after the one that closes it; and the places where a type may be declared.
        self.closed: dict[int, int] = {}
        self.typed = [i for i, (kind, t, _) in enumerate(self.tokens) if kind == "name" and t in TYPES]
        opened: list[int] = []
        for i, (kind, t, _) in enumerate(self.tokens):
            if kind == "sign" and t in OPEN:
                opened.append(i)
            elif kind == "sign" and t in CLOSE and opened:
                self.closed[opened.pop()] = i + 1
        self.closed.update((i, self.n - 1) for i in opened)
        self.package, self.imports, self.statics, self.wildcards = "", {}, {}, []
        self.imported: list[tuple[str, int]] = []
        self.symbols: dict[str, str] = {}
        self.supers: dict[str, list[str]] = {}
        self.callback: dict[str, bool] = {}
        self.results: dict[str, str] = {}
        self.fields: dict[str, str] = {}
        self.field_values: dict[str, str] = {}
        self.units: list[Unit] = []
        self.relations: list[Relation] = []
        self.declare = self.units_only = False
        self.test_file = path.endswith(("Test.java", "Tests.java", "Spec.java"))

    # tokens ------------------------------------------------------------------------------------------------------

    def text(self, i: int) -> str:
        return self.words[i] if i < self.n else ""

    def is_name(self, i: int) -> bool:
        return i < self.n and self.tokens[i][0] == "name" and self.words[i] not in WORDS

    def after(self, i: int) -> int:
        """The place after the bracket that closes the one at ``i``."""
        if i in self.closed:
            return self.closed[i]
        depth = 0
        while i < len(self.tokens) - 1:
            t, kind = self.tokens[i][1], self.tokens[i][0]
            if kind == "sign":
                depth += (t in OPEN) - (t in CLOSE)
                if depth == 0:
                    return i + 1
            i += 1
        return i

    def angled(self, i: int) -> int | None:
        """The place after type parameters that open at ``i``; None if they are none."""
        depth = 0
        while i < len(self.tokens):
            t = self.text(i)
            depth += (t == "<") - (t == ">")
            if depth == 0:
                return i + 1
            if not (t in "<>,?.&[]@" or self.tokens[i][0] == "name"):
                return None
            i += 1
        return None

    def kind_at(self, i: int) -> tuple[str, int] | None:
        """A type that starts at ``i``, as text, and the place after it."""
        while self.text(i) == "@" and self.is_name(i + 1):
            i = self.mark(i)[1]
        if self.tokens[i][0] != "name" or (self.text(i) in WORDS and self.text(i) != "void"):
            return None
        out = self.text(i)
        i += 1
        while True:
            if self.text(i) == "<" and out not in PRIMITIVES:
                end = self.angled(i)
                if end is None:
                    return None
                out += "<" + ", ".join(self._parts(i + 1, end - 1)) + ">"
                i = end
            elif self.text(i) == "." and self.is_name(i + 1):
                out += "." + self.text(i + 1)
                i += 2
            else:
                break
        while self.text(i) == "[" and self.text(i + 1) == "]":
            out += "[]"
            i += 2
        return out, i

    def _parts(self, i: int, end: int) -> list[str]:
        parts, depth = [""], 0
        for j in range(i, end):
            t = self.text(j)
            depth += (t == "<") - (t == ">")
            if t == "," and not depth:
                parts.append("")
            else:
                parts[-1] += f" {t} " if t in ("extends", "super") else t
        return [p.strip() for p in parts]

    def mark(self, i: int) -> tuple[str, int]:
        """The annotation at ``i`` and the place after it."""
        name, i = self.text(i + 1), i + 2
        while self.text(i) == "." and self.is_name(i + 1):
            name, i = f"{name}.{self.text(i + 1)}", i + 2
        return f"@{name}", self.after(i) if self.text(i) == "(" else i

    def dotted(self, i: int) -> tuple[str, int]:
        out = self.text(i)
        i += 1
        while self.text(i) == ".":
            out, i = f"{out}.{self.text(i + 1)}", i + 2
        return out, i

    # declarations -------------------------------------------------------------------------------------------------

    def read(self, units_only: bool = False) -> None:
        """Read the file.  Without relations, only those bodies are read that declare a type or extend one where they make it."""
        self.units_only = units_only
        if units_only:
            self.typed = sorted({*self.typed, *(i for i, t in enumerate(self.words) if t == "new" and (k := self.kind_at(i + 1)) and self.text(k[1]) == "(" and self.text(self.after(k[1])) == "{")})
        i = 0
        while i < len(self.tokens) and self.text(i) not in ("class", "interface", "enum", "record"):
            if self.text(i) == "package":
                self.package, i = self.dotted(i + 1)
            elif self.text(i) == "import":
                i = self._import(i)
            elif self.text(i) == "@" and self.text(i + 1) == "interface":
                break
            elif self.text(i) == "@":
                i = self.mark(i)[1]
            elif self.text(i) in MODIFIERS:
                break
            else:
                i += 1
        first = i
        self.symbols = {}
        if units_only:
            self.members(first, len(self.tokens) - 3, None)
            return
        self.declare = True  # the names of the file first, then what refers to them
        self.members(first, len(self.tokens) - 3, None)
        self.declare, self.units, self.relations = False, [], []
        self.supers, self.callback, self.results, self.fields, self.field_values = {}, {}, {}, {}, {}
        self.members(first, len(self.tokens) - 3, None)

    def _import(self, i: int) -> int:
        line, static = self.tokens[i][2], self.text(i + 1) == "static"
        name, i = self.dotted(i + 1 + static)
        if name.endswith(".*"):
            if static:
                self.wildcards.append(name[:-2])
        elif static:
            owner, _, member = name.rpartition(".")
            self.statics[member] = f"{owner}#{member}"
        else:
            self.imports[name.rpartition(".")[2]] = name
            self.imported.append((name, line))
        return i + 1

    def members(self, i: int, end: int, scope: Scope | None) -> None:
        """Declarations between ``i`` and ``end``."""
        while i < end:
            i = self.member(i, end, scope)

    def member(self, i: int, end: int, scope: Scope | None) -> int:
        first, marks, mods = i, [], []
        while True:
            t = self.text(i)
            if t == "@" and self.text(i + 1) == "interface":
                return self.type(i + 2, "@interface", first, marks, mods, scope)
            if t == "@":
                name, i = self.mark(i)
                marks.append(name)
            elif t == "non" and self.text(i + 1) == "-":
                i += 3
            elif t in MODIFIERS and not (t == "default" and self.text(i + 1) in (":", "->")):
                mods.append(t)
                i += 1
            else:
                break
        t = self.text(i)
        if t in TYPES and self.is_name(i + 1) and (t != "record" or self.text(i + 2) in ("(", "<")):
            return self.type(i + 1, t, first, marks, mods, scope)
        if t == "{":
            return self.after(i)
        if scope is None or t in ("", ";", ",") or i >= end:
            return i + 1
        if t == "<":
            i = self.angled(i) or i + 1
        simple = re.split(r"[.$]", scope.owner)[-1]
        if self.text(i) == simple and self.text(i + 1) == "(":
            return self.callable(i, None, first, marks, mods, scope)
        if self.text(i) == simple and self.text(i + 1) == "{":  # a record's compact constructor
            return self.after(i + 1)
        found = self.kind_at(i)
        if found is None:
            return i + 1
        kind, j = found
        if not self.is_name(j):
            return j
        if self.text(j + 1) == "(":
            return self.callable(j, kind, first, marks, mods, scope)
        return self.variables(j, kind, first, marks, mods, scope)

    def type(self, i: int, word: str, first: int, marks: list[str], mods: list[str], scope: Scope | None) -> int:
        name, kind = self.text(i), TYPES[word]
        local = scope is not None and scope.member is not None
        full = f"{scope.owner}${name}" if scope is not None and not local else f"{self.package}.{name}" if self.package else name
        i += 1
        if self.text(i) == "<":
            i = self.angled(i) or i + 1
        header = ""
        if self.text(i) == "(":
            header = "(" + ", ".join(f"{k} {n}" for k, n, _ in self.parameters(i)) + ")"
            i = self.after(i)
        above: dict[str, list[str]] = {"extends": [], "implements": []}
        part = ""
        while self.text(i) not in ("{", ""):
            if self.text(i) in ("extends", "implements", "permits"):
                part, i = self.text(i), i + 1
            elif (found := self.kind_at(i)) is not None:
                if part in above:
                    above[part].append(plain(found[0]).rpartition(".")[2])
                i = found[1]
            else:
                i += 1
        stop = self.after(i)
        ident, line = self.ident(kind, full), self.tokens[first][2]
        self.symbols.setdefault(full, ident)
        if word == "record":
            shown = f"record {name}{header}"
        elif word in ("class", "interface"):
            shown = " ".join([*mods, word, name]) + "".join(f" {p} {', '.join(v)}" for p, v in above.items() if v)
        else:
            shown = f"{word} {name}"
        entry = word in ("class", "interface", "record") and any(m in ENTRIES for m in marks)
        self.units.append(Unit(kind, full, name, line, self.tokens[stop - 1][2], shown, [] if word == "@interface" else marks, scope.owner if scope else None, entry))
        if scope is not None:
            self.relate(self.symbols.get(scope.owner, scope.owner), ident, "CONTAINS", line)
        inner = Scope(full, listed=word in ("class", "interface"))
        if word in ("class", "interface"):
            self.supers[full] = [self.kind_name(x, scope) for x in above["extends"]]
            for x, edge in [(x, "EXTENDS") for x in above["extends"]] + [(x, "IMPLEMENTS") for x in above["implements"]]:
                to = self.kind_name(x, scope)
                self.relate(ident, self.symbols.get(to, to), edge, line)
            self.callback[full] = any(x in CALLBACKS for x in above["implements"])
        inside = i + 1
        if word == "enum":
            inside = self.constants(inside, stop - 1, inner)
        if word != "@interface":
            self.members(inside, stop - 1, inner)
        return stop

    def constants(self, i: int, end: int, scope: Scope) -> int:
        """The place after the constants of an enum."""
        while i < end and self.text(i) != ";":
            if self.text(i) == "{":
                stop = self.after(i)
                self.members(i + 1, stop - 1, scope)
                i = stop
            else:
                i = self.after(i) if self.text(i) in ("(", "[") else i + 1
        return i + 1

    def parameters(self, i: int) -> list[tuple[str, str, bool]]:
        """(type, name, whether it takes any number) of the parameters in the brackets at ``i``."""
        out, end = [], self.after(i) - 1
        i += 1
        while i < end:
            while self.text(i) == "final" or self.text(i) == "@":
                i = i + 1 if self.text(i) == "final" else self.mark(i)[1]
            found = self.kind_at(i)
            if found is None:
                i += 1
                continue
            kind, i = found
            many = self.text(i) == "..."
            i += many
            if self.is_name(i):
                name, i = self.text(i), i + 1
                while self.text(i) == "[":
                    kind, i = kind + "[]", i + 2
                out.append((kind, name, many))
            while i < end and self.text(i) != ",":
                i += 1
            i += 1
        return out

    def callable(self, i: int, result: str | None, first: int, marks: list[str], mods: list[str], scope: Scope) -> int:
        """A method (with a result) or a constructor whose name stands at ``i``."""
        simple, params = self.text(i), self.parameters(i + 1)
        full = f"{scope.owner}#{simple}({','.join(plain(k) + ('...' if many else '') for k, _, many in params)})"
        kind = "METHOD" if result else "CONSTRUCTOR"
        ident, line = self.ident(kind, full), self.tokens[first][2]
        j = self.after(i + 1)
        thrown = []
        if self.text(j) == "throws":
            while self.text(j) in ("throws", ","):
                name, j = self.dotted(j + 1)
                thrown.append(name)
        while self.text(j) not in ("{", ";", ""):
            j += 1
        stop = self.after(j) if self.text(j) == "{" else j + 1
        if scope.listed:
            self.symbols.setdefault(full, ident)
        shown = " ".join([*mods, *([result] if result else []), simple]) + "(" + ", ".join(f"{k} {n}" for k, n, _ in params) + ")" + (f" throws {', '.join(thrown)}" if result and thrown else "")
        overrides = result is not None and "@Override" in marks
        entry = result is not None and (any(m in ENTRIES for m in marks) or (overrides and self.callback.get(scope.owner, False)))
        test = result is not None and (self.test_file or any(m in TESTS for m in marks))
        own = Scope(scope.owner, ident)
        if result is not None:
            for k in [*(k for k, _, _ in params), *([] if result == "void" else [result])]:
                if plain(k) not in PRIMITIVES:
                    self.relate(ident, self.kind_name(plain(k), scope), "DEFINES_TYPE", line)
            if result != "void" and result not in PRIMITIVES:
                self.results[f"{scope.owner}#{simple}"] = self.kind_name(plain(result), scope)
        self.units.append(Unit(kind, full, simple, line, self.tokens[stop - 1][2], shown, marks, scope.owner, entry, test))
        self.relate(self.symbols.get(scope.owner, scope.owner), ident, "CONTAINS", line)
        if overrides:
            self.relate(ident, f"{scope.owner}#{simple}", "OVERRIDES", line)
        for k, n, many in params:
            own.values[n] = plain(k) + ("[]" if many else "")
            if plain(k) not in PRIMITIVES:
                own.variables[n] = self.kind_name(plain(k), scope)
        if self.text(j) == "{":
            self.body(j + 1, stop - 1, own)
        return stop

    def variables(self, i: int, kind: str, first: int, marks: list[str], mods: list[str], scope: Scope) -> int:
        """Fields whose first name stands at ``i``."""
        base = kind.rstrip("[]") if kind.endswith("[]") else kind
        while self.is_name(i):
            name, line, j = self.text(i), self.tokens[i][2], i + 1
            while self.text(j) == "[":
                j += 2
            full = f"{scope.owner}.{name}"
            ident = self.ident("FIELD", full)
            stop = j
            if self.text(j) == "=":
                stop = self.expression_end(j + 1)
            self.units.append(Unit("FIELD", full, name, line, self.tokens[stop - 1][2], " ".join([*mods, base, name]), marks, scope.owner))
            self.relate(self.symbols.get(scope.owner, scope.owner), ident, "CONTAINS", line)
            self.field_values[name] = plain(base)
            if base not in PRIMITIVES:
                self.fields[name] = self.kind_name(plain(base), scope)
                self.relate(ident, self.kind_name(plain(base), scope), "DEFINES_TYPE", line)
            if self.text(j) == "=":
                self.body(j + 1, stop, Scope(scope.owner, ident))
            i = stop + 1 if self.text(stop) == "," else stop
            if self.text(stop) != ",":
                break
        return i + 1

    def expression_end(self, i: int) -> int:
        """The comma or semicolon that ends the expression at ``i``."""
        while self.text(i) not in (",", ";", ""):
            if self.text(i) == "<" and (end := self.angled(i)) is not None and self.text(end) in ("(", ">", ",", "::", "."):
                i = end
            else:
                i = self.after(i) if self.text(i) in OPEN else i + 1
        return i

    # bodies -------------------------------------------------------------------------------------------------------

    def body(self, i: int, end: int, scope: Scope) -> None:
        """Calls and variables between ``i`` and ``end``."""
        if (self.declare or self.units_only) and bisect_left(self.typed, i) == bisect_left(self.typed, end):
            return  # no type is declared here
        fresh = True  # whether a declaration may start here
        while i < end:
            t = self.text(i)
            if fresh and t in ("final", "abstract", "static"):
                i += 1
                continue
            if fresh and t == "@" and self.text(i + 1) != "interface":
                i = self.mark(i)[1]
                continue
            if t == "(" and self.text(i - 1) in ("for", "try", "while", "if", "switch", "catch", "synchronized"):
                fresh, i = True, i + 1
                continue
            if fresh and t in TYPES and self.is_name(i + 1) and (t != "record" or self.text(i + 2) in ("(", "<")):
                i = self.type(i + 1, t, i, [], [], scope)
                continue
            if fresh and (found := self.kind_at(i)) is not None and self.is_name(found[1]) and self.text(found[1] + 1) in ("=", ";", ":", ",", "["):
                kind, i = found
                names = [i]
                if self.text(i + 1) in ("=", ",", "["):
                    j = i + 1
                    while self.text(j) == "[":
                        j += 2
                    while self.text(j) in ("=", ","):
                        j = self.expression_end(j + 1) if self.text(j) == "=" else j
                        if self.text(j) == "," and self.is_name(j + 1) and self.text(j + 2) in ("=", ",", ";"):
                            names.append(j + 1)
                            j += 2
                        else:
                            break
                base = plain(kind[:-2] if kind.endswith("[]") else kind)
                for at in names:
                    scope.values[self.text(at)] = base
                    if base not in PRIMITIVES:
                        scope.variables[self.text(at)] = self.kind_name(base, scope)
                i += 1
                fresh = False
                continue
            fresh = t in ("{", "}", ";", "(") or t in ("else", "do", "->", "finally", "try") or (t == ":" and not fresh)
            i = self.chain(i, end, scope)[1] if self.starts(i) else i + 1

    def starts(self, i: int) -> bool:
        kind, t, _ = self.tokens[i]
        return kind in ("text", "char", "number") or t in ("this", "super", "new", "(") or self.is_name(i) or t in ("true", "false", "null")

    def arguments(self, i: int, scope: Scope) -> list[str | None]:
        """Types of the arguments in the brackets at ``i`` (None where unknown); the calls in them are read."""
        end, out = self.after(i) - 1, []
        j = i + 1
        while j < end:
            stop = min(self.expression_end(j), end)
            out.append(self.value_type(j, stop, scope))
            self.body_of(j, stop, scope)
            j = stop + 1
        return out

    def body_of(self, i: int, end: int, scope: Scope) -> None:
        """As ``body``, where no declaration can start."""
        while i < end:
            if self.text(i) == "{":
                stop = self.after(i)
                self.body(i + 1, stop - 1, scope)
                i = stop
            else:
                i = self.chain(i, end, scope)[1] if self.starts(i) else i + 1

    def value_type(self, i: int, end: int, scope: Scope) -> str | None:
        """The type that an argument shows by itself."""
        kind, t, _ = self.tokens[i]
        one = end == i + 1
        if one and kind == "text":
            return None if t.startswith('"""') else "String"
        if one and kind == "char":
            return "char"
        if one and kind == "number":
            low = t.lower()
            if low.startswith("0x") or not re.search(r"[.efd]", low):
                return "long" if low.endswith("l") else "int"
            return "float" if low.endswith("f") else "double"
        if one and t in ("true", "false"):
            return "boolean"
        if one and self.is_name(i):
            return scope.values.get(t) or self.field_values.get(t)
        if t == "this" and self.text(i + 1) == "." and end == i + 3:
            return self.field_values.get(self.text(i + 2))
        if t == "new" and (found := self.kind_at(i + 1)) is not None and self.text(found[1]) == "(":
            stop = self.after(found[1])
            return plain(found[0]) if end in (stop, self.after(stop) if self.text(stop) == "{" else stop) else None
        if t == "(" and (found := self.kind_at(i + 1)) is not None and self.text(found[1]) == ")" and self.casts(found[1] + 1):
            return plain(found[0])
        return None

    def casts(self, i: int) -> bool:
        """Whether what stands at ``i``, after a type in brackets, is what is cast."""
        kind, t, _ = self.tokens[i]
        return kind in ("text", "char", "number", "name") and t != "instanceof" or t in ("(", "!", "~")

    def chain(self, i: int, end: int, scope: Scope) -> tuple[tuple, int]:
        """An expression of names, calls and fields that starts at ``i``, and the place after it."""
        kind, t, line = self.tokens[i]
        if t == "new":
            found = self.kind_at(i + 1)
            if found is None:
                return ("other",), i + 1
            made, j = found
            if self.text(j) != "(":
                return ("other",), j
            types = self.arguments(j, scope)
            if scope.member:
                owner = self.kind_name(plain(made).rpartition(".")[2], scope)
                self.relate(scope.member, f"{owner}#<init>({','.join('Object' for _ in types)})", "CALLS", line)
            j = self.after(j)
            if self.text(j) == "{":
                stop = self.after(j)
                self.members(j + 1, stop - 1, Scope(scope.owner))
                j = stop
            return self.rest(("other",), "", j, line, end, scope)
        if t == "(":
            stop = self.after(i)
            if self.text(stop) == "->":
                return ("other",), stop + 1
            found = self.kind_at(i + 1)
            if found is not None and found[1] == stop - 1 and self.casts(stop) and (found[0] in PRIMITIVES or self.tokens[stop][0] != "sign" or self.text(stop) == "("):
                return ("other",), stop
            self.body_of(i + 1, stop - 1, scope)
            return self.rest(("other",), "", stop, line, end, scope)
        if t in ("this", "super") and self.text(i + 1) == "(":
            types = self.arguments(i + 1, scope)
            if t == "this" and scope.member:
                simple = re.split(r"[.$]", scope.owner)[-1]
                to = self.by_owner(simple, scope.owner, [None] * len(types))
                to = self.symbols.get(to, to)
                if to != scope.member:
                    self.relate(scope.member, to, "CALLS", line)
            return ("other",), self.after(i + 1)
        if t == "this":
            return self.rest(("this",), "this", i + 1, line, end, scope)
        if self.is_name(i):
            if self.text(i + 1) == "(":
                types = self.arguments(i + 1, scope)
                self.call(None, "", t, types, line, scope)
                return self.rest(("call", None, t), "()", self.after(i + 1), line, end, scope)
            if self.text(i + 1) == "->":
                return ("other",), i + 2
            return self.rest(("name", t), t, i + 1, line, end, scope)
        return self.rest(("other",), t if kind == "text" else "", i + 1, line, end, scope)

    def rest(self, expr: tuple, shown: str, i: int, line: int, end: int, scope: Scope) -> tuple[tuple, int]:
        """What follows an expression: fields, calls, places of arrays, references to methods."""
        while i < end:
            t = self.text(i)
            if t == "." and self.text(i + 1) == "<":
                i = (self.angled(i + 1) or i + 2) - 1
                t = "."
            if t == "." and (self.is_name(i + 1) or self.text(i + 1) in ("this", "class", "super", "new")):
                name = self.text(i + 1)
                if self.text(i + 2) == "(" and self.is_name(i + 1):
                    types = self.arguments(i + 2, scope)
                    self.call(expr, shown, name, types, line, scope)
                    expr, shown, i = ("call", expr, name), f"{shown}.{name}()", self.after(i + 2)
                elif name == "new":
                    return expr, i + 1
                else:
                    expr, shown, i = ("field", expr, name), f"{shown}.{name}", i + 2
            elif t == "[":
                stop = self.after(i)
                self.body_of(i + 1, stop - 1, scope)
                expr, shown, i = ("other",), f"{shown}[]", stop
            elif t == "::" and (self.is_name(i + 1) or self.text(i + 1) == "new"):
                if scope.member:
                    self.reference(expr, shown, self.text(i + 1), line, scope)
                return ("other",), i + 2
            else:
                break
        return expr, i

    # names --------------------------------------------------------------------------------------------------------

    def relate(self, source: str, target: str, kind: str, line: int) -> None:
        if not self.declare and not self.units_only:
            self.relations.append(Relation(source, target, kind, line))

    def kind_name(self, name: str, scope: Scope | None) -> str:
        """The qualified name of a type."""
        if "." in name:
            return name
        if name in self.imports:
            return self.imports[name]
        if scope is not None and f"{scope.owner}${name}" in self.symbols:
            return f"{scope.owner}${name}"
        return f"{self.package}.{name}" if self.package else name

    def receiver(self, shown: str, scope: Scope) -> str | None:
        """The type behind the text of a receiver."""
        if not shown:
            return None
        known = scope.owner if shown == "this" else scope.variables.get(shown) or self.fields.get(shown) or self.imports.get(shown)
        if known:
            return known
        if "." in shown:
            return shown.rpartition(".")[0]
        return f"{self.package}.{shown}" if self.package and shown[0].isupper() else None

    def type_of(self, expr: tuple, scope: Scope) -> str | None:
        if expr[0] == "this":
            return scope.owner
        if expr[0] == "name":
            return self.receiver(expr[1], scope)
        if expr[0] == "field":
            return self.fields.get(expr[2]) if expr[1] == ("this",) else None
        if expr[0] == "call":
            owner = scope.owner if expr[1] is None else self.type_of(expr[1], scope)
            return self.results.get(f"{owner}#{expr[2]}") if owner else None
        return None

    @staticmethod
    def pick(names: list[str], types: list[str | None]) -> str | None:
        """The one that the arguments leave: all of their types tell more than their number."""
        bare = lambda k: re.sub(r"^.*\.", "", plain(k).replace("...", "[]").replace(" ", ""))
        params = {n: [p for p in n[n.index("(") + 1 : n.rindex(")")].split(",") if p] if "(" in n else None for n in names}
        if len(names) > 1 and all(types):
            same = [n for n in names if [bare(p) for p in params[n] or []] == [bare(k) for k in types]]
            if len(same) == 1:
                return same[0]
        if len(names) > 1:
            names = [n for n in names if params[n] is not None and len(params[n]) == len(types)] or names
        return names[0] if len(names) == 1 else None

    @staticmethod
    def unknown(base: str, types: list[str | None]) -> str:
        return f"{base}({','.join(types)})" if all(types) else f"{base}::arity={len(types)}"

    def by_owner(self, name: str, owner: str, types: list[str | None] | None) -> str:
        base = f"{owner}#{name}"
        own = [s for s in self.symbols if s == base or s.startswith(f"{base}(")]
        if types is None:
            return own[0] if len(own) == 1 else base
        return self.pick(own, types) or self.unknown(base, types)

    def ancestors(self, owner: str) -> set[str]:
        found, open_ = set(), [owner]
        while open_:
            if (x := open_.pop()) not in found:
                found.add(x)
                open_ += self.supers.get(x, [])
        return found

    def call(self, expr: tuple | None, shown: str, name: str, types: list[str | None], line: int, scope: Scope) -> None:
        if not scope.member:
            return
        owner = self.type_of(expr, scope) if expr else None
        if owner:
            to = self.by_owner(name, owner, types)
        elif expr is None and name in self.statics:
            to = self.unknown(self.statics[name], types)
        elif expr is None and len(self.wildcards) == 1:
            to = self.unknown(f"{self.wildcards[0]}#{name}", types)
        else:
            owner = self.receiver(shown, scope) if expr else None
            near = [s for s in self.symbols if re.search(rf"#{re.escape(name)}(\(|$)", s)]
            if expr is None:
                line_of = self.ancestors(scope.owner)
                near = [s for s in near if s.partition("#")[0] in line_of] or near
            elif owner:
                near = [s for s in near if s.startswith(f"{owner}#")] or near
            to = self.pick(near, types) or self.unknown(f"{owner or scope.owner}#{name}", types)
        self.relate(scope.member, self.symbols.get(to, to), "CALLS", line)

    def reference(self, expr: tuple, shown: str, name: str, line: int, scope: Scope) -> None:
        owner = self.type_of(expr, scope) or self.receiver(shown, scope)
        self.relate(scope.member, self.by_owner(name, owner, None) if owner else f"{scope.owner}#{name}", "CALLS", line)
