"""Readers of JavaScript, TypeScript and C sources on tokens: functions, types and members with the calls they make.

A call names the function of the same file that came before it (or itself) by its last name, else an id that no unit has;
calls of and on names that the language brings along give nothing.
"""

from __future__ import annotations

import re

#: Names that come with the language, and names of entries.
JS_BUILTINS = (
    "require", "console", "JSON", "Math", "Object", "Array", "Promise", "process", "Buffer", "Map", "Set", "Date", "Reflect", "Symbol", "setTimeout", "setInterval", "clearTimeout", "clearInterval",
    "fetch", "parseInt", "parseFloat", "isNaN", "encodeURIComponent", "decodeURIComponent", "structuredClone", "queueMicrotask",
)
C_BUILTINS = (
    "printf", "fprintf", "sprintf", "snprintf", "scanf", "sscanf", "malloc", "calloc", "realloc", "free", "memcpy", "memmove", "memset", "memcmp", "strlen", "strcpy", "strncpy", "strcmp", "strncmp", "strcat", "strncat", "strchr", "strrchr",
    "fopen", "fclose", "fread", "fwrite", "fgets", "fputs", "exit", "abort", "assert", "BUG_ON", "WARN_ON", "kmalloc", "kfree", "kzalloc", "container_of", "ARRAY_SIZE", "printk", "spin_lock", "spin_unlock", "mutex_lock", "mutex_unlock",
)
JS_ENTRIES = (("main",), ("handle", "init", "start", "run", "serve"), ("Handler", "Callback", "Listener"))
C_ENTRIES = (("main",), ("init_", "start_", "run_", "cmd_", "server_", "client_", "handle_"), ("_init", "_start", "_run", "_open", "_close", "_handler", "_callback"))

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")
JS_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<number>\d[\w.]*)|(?P<name>[#@]?[^\W\d][\w$]*|\$[\w$]*)|(?P<sign>=>|\?\.(?!\d)|\.\.\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|.)", re.S
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
C_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/|\\\n)|(?P<line>^[ \t]*\#(?:\\\n|[^\n])*)|(?P<text>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+')|(?P<number>\d[\w.]*)|(?P<name>[^\W\d]\w*)|(?P<sign>->|\.\.\.|==|!=|<=|>=|&&|\|\||.)", re.S | re.M
)
JS_WORDS = frozenset("if for while switch catch with return typeof void delete throw new in of instanceof do else case function class await yield".split())


def is_entry(name: str, known: tuple) -> bool:
    return name in known[0] or name.startswith(known[1]) or name.endswith(known[2])


class Tokens:
    """Tokens (kind, text, line, begin, end) of a source."""

    def __init__(self, source: str, pattern: re.Pattern, slashes: bool = False):
        self.source, self.all, line, at = source, [], 1, 0
        while at < len(source):
            m = None
            if slashes and source[at] == "/" and (not self.all or self.all[-1][0] == "sign" and self.all[-1][1] not in (")", "]", "}") or self.all[-1][1] in ("return", "typeof", "case")):
                m = REGEX.match(source, at)
            kind = "text" if m else ""
            m = m or pattern.match(source, at)
            kind = kind or m.lastgroup
            if kind != "skip":
                self.all.append((kind, m[0], line, at, m.end()))
            line += m[0].count("\n")
            at = m.end()
        self.n = len(self.all)
        self.all += [("end", "", line, at, at)] * 3

    def text(self, i: int) -> str:
        return self.all[i][1] if 0 <= i < len(self.all) else ""

    def kind(self, i: int) -> str:
        return self.all[min(i, len(self.all) - 1)][0] if i >= 0 else ""

    def line(self, i: int) -> int:
        return self.all[min(i, len(self.all) - 1)][2]

    def span(self, a: int, b: int) -> str:
        return self.source[self.all[a][3] : self.all[max(a, min(b, self.n) - 1)][4]] if a < b else ""

    def last_line(self, b: int) -> int:
        k, t, line, *_ = self.all[max(0, min(b, self.n) - 1)]
        return line + t.count("\n")

    def after(self, i: int) -> int:
        depth = 0
        while i < self.n:
            if self.all[i][0] == "sign":
                depth += (self.all[i][1] in OPEN) - (self.all[i][1] in CLOSE)
                if depth <= 0:
                    return i + 1
            i += 1
        return self.n

    def angled(self, i: int) -> int | None:
        """The place after type parameters that open at ``i``; None if they are none."""
        depth = 0
        for j in range(i, min(self.n, i + 200)):
            t = self.text(j)
            depth += (t == "<") - (t == ">")
            if depth == 0:
                return j + 1
            if t in (";", "{", "}", "(", ")", "=>", "&&", "||", "=") or self.kind(j) in ("number",):
                return None
        return None


class Script:
    """Units (kind, name, simple, start, end, source, signature, parent, entry) and calls (unit, target, known, line) of a script."""

    def __init__(self, source: str):
        self.t = Tokens(source, JS_TOKEN, True)
        self.units: list[tuple] = []
        self.calls: list[tuple[int, int | str, int]] = []
        self.functions: dict[str, int] = {}
        self.walk(0, self.t.n, None)

    def add(self, kind: str, name: str, a: int, b: int, signature: str, parent: str | None = None) -> int:
        simple = name.rpartition(".")[2]
        entry = kind in ("FUNCTION", "METHOD") and is_entry(simple, JS_ENTRIES)
        self.units.append((kind, name, simple, self.t.line(a), self.t.last_line(b), self.t.span(a, b), signature, parent, entry))
        return len(self.units) - 1

    def name(self, i: int) -> bool:
        return self.t.kind(i) == "name" and self.t.text(i) not in JS_WORDS

    def body_at(self, i: int, end: int) -> int | None:
        """The brace that opens the body after parameters that end before ``i``, perhaps behind the type of the result."""
        if self.t.text(i) == ":":
            i += 1
            while i < end and self.t.text(i) not in ("{", ";", "=>", ")", ",", "="):
                i = self.t.after(i) if self.t.text(i) in ("(", "[") else i + 1
        return i if self.t.text(i) == "{" else None

    def function(self, a: int, name: str, params: int, body: int | None, end: int, label: str, owner: str | None) -> int:
        """A unit from ``a`` to ``end`` whose parameters open at ``params`` and whose body is from ``body`` on."""
        shown = self.t.span(params, self.t.after(params)) if self.t.text(params) == "(" else self.t.text(params)
        unit = self.add("METHOD" if owner else "FUNCTION", name, a, end, label + shown, owner)
        self.functions[name.rpartition(".")[2]] = unit
        if body is not None:
            self.find(body, end, unit)
        return end

    def walk(self, i: int, end: int, owner: str | None) -> None:
        """Declarations between ``i`` and ``end``; what is inside functions and named values is not looked at."""
        while i < end:
            i = self.step(i, end, owner)

    def step(self, i: int, end: int, owner: str | None) -> int:
        t, text = self.t, self.t.text(i)
        before = t.text(i - 1) if i else ""
        starts = before in ("", ";", "}", "{", ")", "export", "default", "async", "declare", "abstract", ":") or t.kind(i - 1) in ("text", "number") or t.line(i) > t.line(i - 1)
        if text == "function" and starts and before != "default" and self.name(j := i + 1 + (t.text(i + 1) == "*")):
            params = t.angled(j + 1) or j + 1 if t.text(j + 1) == "<" else j + 1
            if t.text(params) == "(":
                body = self.body_at(t.after(params), end)
                stop = t.after(body) if body is not None else t.after(params)
                first = i - 1 if before == "async" else i
                return self.function(first, t.text(j), params, body, stop, f"function {t.text(j)}", owner) if body is not None else stop
        if text == "class" and self.name(i + 1) and before != ".":
            return self.type(i, before == "abstract")
        if text in ("interface", "enum", "type") and starts and self.name(i + 1) and t.text(i + 2) in ("{", "extends", "<", "="):
            return self.named(i, end)
        if text in ("const", "let", "var") and before != ".":
            return self.values(i + 1, end, owner)
        if self.name(i) and text not in ("function", "super") and t.text(i + 1) == "(" and before in (",", "{", "async", "get", "set", "*", "static") and t.text(t.after(i + 1)) == "{":
            stop = t.after(t.after(i + 1))  # a method of an object
            return self.function(i, text, i + 1, t.after(i + 1), stop, text, owner)
        return i + 1

    def type(self, i: int, abstract: bool) -> int:
        t, name, j = self.t, self.t.text(i + 1), i + 2
        while j < t.n and t.text(j) != "{":
            j = t.after(j) if t.text(j) in ("(", "[") else j + 1
        stop = t.after(j)
        self.add("CLASS", name, i - 1 if abstract else i, stop, ("abstract class " if abstract else "class ") + name)
        j += 1
        while j < stop - 1:
            j = self.member(j, stop - 1, name)
        return stop

    def member(self, i: int, end: int, owner: str) -> int:
        t, a = self.t, i
        while t.text(i) in ("static", "public", "private", "protected", "readonly", "abstract", "override", "async", "get", "set", "*", "declare") and t.text(i + 1) not in ("(", "=", ";", ":", "?", "!"):
            i += 1
        if t.text(i).startswith("@"):
            i += 1
            return t.after(i) if t.text(i) == "(" else i
        if t.kind(i) != "name" and t.kind(i) != "text":
            return t.after(i) if t.text(i) in OPEN else i + 1
        name, j = t.text(i), i + 1
        if t.text(j) == "<":
            j = t.angled(j) or j
        if t.text(j) == "(":
            body = self.body_at(t.after(j), end)
            if body is not None:
                return self.function(a, f"{owner}.{name}", j, body, t.after(body), name, owner)
            stop = t.after(j)
            while stop < end and t.text(stop) != ";" and t.line(stop) == t.line(stop - 1):
                stop += 1
            if "abstract" in [t.text(k) for k in range(a, i)]:
                self.function(a, f"{owner}.{name}", j, None, stop, name, owner)
            return stop + 1
        stop = j
        while stop < end and t.text(stop) not in (";",):
            if t.text(stop) in OPEN:
                stop = t.after(stop)
            elif stop > j and t.line(stop) > t.line(stop - 1) and t.text(stop - 1) not in ("=", "=>", ",", ":", "|", "&", "+", "?") and t.kind(stop) == "name":
                break
            else:
                stop += 1
        self.add("FIELD", f"{owner}.{name}", a, stop, name, owner)
        return stop + (t.text(stop) == ";")

    def named(self, i: int, end: int) -> int:
        t, word, name, j = self.t, self.t.text(i), self.t.text(i + 1), i + 2
        if word == "type":
            while j < end and t.text(j) != ";" and not (t.line(j) > t.line(j - 1) and t.text(j - 1) not in ("=", "|", "&", ":", "=>", ",") and t.text(j) not in ("|", "&")):
                j = t.after(j) if t.text(j) in OPEN else j + 1
            stop = j + (t.text(j) == ";")
        else:
            while j < end and t.text(j) != "{":
                j += 1
            stop = t.after(j)
        self.add({"interface": "INTERFACE", "enum": "ENUM", "type": "TYPEDEF"}[word], name, i, stop, f"{word} {name}")
        return stop

    def values(self, i: int, end: int, owner: str | None) -> int:
        """Declared names with functions for values; other values are passed over."""
        t = self.t
        while i < end:
            a, name = i, t.text(i) if self.name(i) else ""
            j = i + 1 if name else (t.after(i) if t.text(i) in OPEN else i + 1)
            if t.text(j) == ":":
                while j < end and t.text(j) not in ("=", ";", ","):
                    j = t.after(j) if t.text(j) in OPEN else j + 1
            if t.text(j) != "=":
                if t.text(j) == ",":
                    i = j + 1
                    continue
                return j
            v = j + 1 + (t.text(j + 1) == "async")
            stop = self.value_end(j + 1, end)
            params = v
            if t.text(v) == "function":
                params = next((k for k in range(v, stop) if t.text(k) == "("), v)
            elif t.text(v) == "<":
                params = t.angled(v) or v
            closed = t.after(params) if t.text(params) == "(" else params + 1
            if t.text(v) == "function":
                body = self.body_at(closed, end)
            else:
                arrow = closed
                while t.text(closed) == ":" and arrow < stop and t.text(arrow) != "=>":
                    arrow = t.after(arrow) if t.text(arrow) in OPEN else arrow + 1
                body = arrow + 1 if t.text(arrow) == "=>" and (t.text(params) == "(" or self.name(params)) else None
            if name and body is not None:
                self.function(a, name, params, body, stop, name, owner)
            i = stop + 1
            if t.text(stop) != ",":
                return stop
        return i

    def value_end(self, i: int, end: int) -> int:
        t, begin = self.t, i
        while i < end and t.text(i) not in (",", ";"):
            if i > begin and t.line(i) > t.line(i - 1) and t.text(i) in ("const", "let", "var", "function", "class", "export", "import", "return", "if", "for", "while", "interface", "type", "enum", "async") and t.text(i - 1) not in ("=", "=>", "(", ",", "?", ":"):
                break
            i = t.after(i) if t.text(i) in OPEN else i + 1
        return i

    def find(self, i: int, end: int, unit: int) -> None:
        """The calls between ``i`` and ``end``."""
        while i < end:
            i = self.chain(i, end, unit) if self.t.kind(i) in ("name", "text") or self.t.text(i) in ("(", "[", "{") else i + 1

    def chain(self, i: int, end: int, unit: int) -> int:
        """The place after an expression of names, calls and places that starts at ``i``."""
        t, root, name = self.t, "", ""
        made = t.text(i) == "new"
        if t.kind(i) == "name" and t.text(i) in JS_WORDS and t.text(i) not in ("function", "class"):
            if not made:
                return i + 1
            i += 1
        if t.kind(i) == "name":
            root = name = t.text(i)
            if root == "function":
                j = next((k for k in range(i, min(end, i + 4)) if t.text(k) == "("), i)
                return t.after(j) if j > i else i + 1
            i += 1
        elif t.text(i) in OPEN:
            stop = t.after(i)
            self.find(i + 1, stop - 1, unit)
            i = stop
        else:
            i += 1
        passed = root in JS_BUILTINS and not made
        while i < end:
            x = t.text(i)
            if x in (".", "?.") and t.kind(i + 1) == "name":
                name, i, made = t.text(i + 1), i + 2, False if not made or t.text(i + 2) != "(" else made
            elif x == "?." and t.text(i + 1) in ("(", "["):
                i += 1
            elif x == "!" and t.text(i + 1) in (".", "(", "["):
                i += 1
            elif x == "<" and name and (stop := t.angled(i)) is not None and t.text(stop) == "(":
                i = stop
            elif x == "(" and t.line(i) == t.line(i - 1):
                stop = t.after(i)
                if not passed:
                    if name and not made and name not in JS_BUILTINS:
                        self.calls.append((unit, self.functions.get(name, name), t.line(i)))
                    self.find(i + 1, stop - 1, unit)
                made, name, i = False, "", stop
            elif x == "[" and t.line(i) == t.line(i - 1):
                stop = t.after(i)
                if not passed:
                    self.find(i + 1, stop - 1, unit)
                name, i = "", stop
            elif t.kind(i) == "text" and x.startswith("`"):
                name, i = "", i + 1
            else:
                break
        return i


class CSource:
    """Units, calls, containments and includes of a C source; what conditions of the preprocessor enclose is left out."""

    def __init__(self, source: str):
        self.t = Tokens(source, C_TOKEN)
        self.units: list[tuple] = []
        self.calls: list[tuple[int, int | str, int]] = []
        self.contains: list[tuple[int, int, int]] = []
        self.includes: list[tuple[str, int]] = []
        self.functions: dict[str, int] = {}
        i = depth = 0
        while i < self.t.n:
            if self.t.kind(i) == "line":
                word = re.match(r"\s*#\s*(\w*)", self.t.text(i))[1]
                depth += (word in ("if", "ifdef", "ifndef")) - (word == "endif")
                if not depth:
                    self.directive(i, word)
                i += 1
            elif depth > 0:
                i += 1
            else:
                i = self.declaration(i)

    def add(self, kind: str, name: str, a: int, b: int, signature: str, parent: str | None = None, key: str | None = None) -> int:
        entry = kind == "FUNCTION" and key is None and is_entry(name, C_ENTRIES)
        self.units.append((kind, name, name.rpartition(".")[2], self.t.line(a), self.t.last_line(b), self.t.span(a, b), signature, parent, entry, key or name))
        return len(self.units) - 1

    def directive(self, i: int, word: str) -> None:
        text = self.t.text(i)
        if word == "define" and (m := re.match(r"\s*#\s*define\s+(\w+)(\()?", text)):
            self.add("MACRO", m[1], i, i + 1, f"#define {m[1]}" + ("(...)" if m[2] else ""))
        elif word == "include" and (m := re.match(r'\s*#\s*include\s*"([^"]+)"', text)):
            self.includes.append((m[1], self.t.line(i)))

    def declaration(self, i: int) -> int:
        t, a, typedef = self.t, i, False
        words: list[str] = []
        while t.kind(i) == "name":
            if t.text(i) == "typedef":
                typedef = True
            elif t.text(i) in ("struct", "union", "enum"):
                word, name, j = t.text(i), "", i + 1
                if t.kind(j) == "name":
                    name, j = t.text(j), j + 1
                stop = t.after(j) if t.text(j) == "{" else j
                follows = t.kind(stop) == "name" or t.text(stop) == "*"
                end = self.semicolon(stop)
                called = any(t.text(k) == "(" for k in range(stop, end)) and t.text(j) != "{"
                if typedef:
                    break
                if name and not called:
                    self.composite(word, name, i, stop, j)
                if not called:
                    return end if follows or t.text(stop) == ";" else max(stop, i + 1)
                words.append(f"{word} {name}")
                i = j
                while t.text(i) == "*":
                    i += 1
                continue
            elif t.text(i + 1) == "(" and words:
                return self.function(a, i, words)
            else:
                words.append(t.text(i))
            i += 1
            while t.text(i) == "*":
                i += 1
        if typedef:
            end = self.semicolon(i)
            last = end - 2
            if t.kind(last) == "name":
                self.add("TYPEDEF", t.text(last), a, end, f"typedef ... {t.text(last)}")
            return end
        return max(self.semicolon(i), a + 1)

    def semicolon(self, i: int) -> int:
        t = self.t
        while i < t.n and t.text(i) != ";" and t.kind(i) != "line":
            i = t.after(i) if t.text(i) in OPEN else i + 1
        return i + (t.text(i) == ";")

    def function(self, a: int, i: int, words: list[str]) -> int:
        t, name = self.t, self.t.text(i)
        plain = [w for w in words if w not in ("static", "extern", "inline", "const", "volatile", "register", "restrict")]
        result, types = " ".join(plain), self.parameters(i + 1)
        stop = t.after(i + 1)
        while t.kind(stop) == "name" and stop < t.n:
            stop = t.after(stop + 1) if t.text(stop + 1) == "(" else stop + 1
        if t.text(stop) == "{":
            end = t.after(stop)
            unit = self.add("FUNCTION", name, a, end, f"{result} {name}({types})")
            self.functions[name] = unit
            self.find(stop + 1, end - 1, unit)
            return end
        end = self.semicolon(stop)
        self.add("FUNCTION", name, a, end, f"{result} {name}({types})", key=f"{name}#decl")
        return end

    def parameters(self, i: int) -> str:
        t, out, end, j = self.t, [], self.t.after(i) - 1, i + 1
        while j < end:
            stop = j
            while stop < end and t.text(stop) != ",":
                stop = t.after(stop) if t.text(stop) in OPEN else stop + 1
            names = [t.text(k) for k in range(j, stop) if t.kind(k) == "name" and t.text(k) not in ("const", "volatile", "register", "restrict")]
            if t.text(j) == "...":
                out.append("...")
            elif names:
                words = ("unsigned", "signed", "long", "short", "int", "char", "double", "float")
                n = 2 if names[0] in ("struct", "union", "enum") else next((k for k, w in enumerate(names) if w not in words), len(names)) or 1
                out.append(" ".join(names[:n]))
            j = stop + 1
        return ",".join(out)

    def composite(self, word: str, name: str, a: int, stop: int, body: int) -> None:
        kind = word.upper()
        unit = self.add(kind, name, a, stop, f"{word} {name}")
        if self.t.text(body) != "{" or word == "enum":
            return
        t, j = self.t, body + 1
        while j < stop - 1:
            end = self.semicolon(j)
            names = [k for k in range(j, end) if t.kind(k) == "name" and t.text(k + 1) in (";", ",", "[", ":") and t.text(k - 1) != ":"]
            if names:
                shown = t.span(j, names[0]).rstrip("* ").removeprefix("const ").strip()
                for k in names:
                    own = self.add("FIELD", f"{name}.{t.text(k)}", j, end, f"{shown} {t.text(k)}", name)
                    self.units[own] = (*self.units[own][:3], t.line(k), t.line(k), *self.units[own][5:])
                    self.contains.append((unit, own, t.line(k)))
            j = max(end, j + 1)

    def find(self, i: int, end: int, unit: int) -> None:
        t = self.t
        for k in range(i, end):
            if t.kind(k) == "name" and t.text(k + 1) == "(" and t.text(k) not in ("if", "for", "while", "switch", "return", "sizeof") and t.text(k) not in C_BUILTINS:
                self.calls.append((unit, self.functions.get(t.text(k), t.text(k)), t.line(k)))
