"""Expressions over names, versions and source texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tokens that add one path each; overlapping tokens count on their own.
BRANCHES = ("if (", "if(", "else if", "for (", "for(", "while (", "while(", "do {", "do{", "case ", "catch (", "catch(", " && ", " || ", " ? ")


#: Spellings of scanners on the scale of severities.
SEVERITIES = {
    "CRITICAL": ("ERROR", "CRITICAL", "BLOCKER"),
    "HIGH": ("HIGH", "MAJOR"),
    "MEDIUM": ("WARNING", "WARN", "MEDIUM", "MODERATE"),
    "LOW": ("LOW", "MINOR"),
    "INFO": ("INFO", "INFORMATIONAL", "NOTE"),
}


def occurrences(text: Column, token: str | Column) -> Column:
    """Non-overlapping occurrences of a literal in a text."""
    token = F.lit(token) if isinstance(token, str) else token
    return ((F.char_length(text) - F.char_length(F.replace(text, token, F.lit("")))) / F.char_length(token)).cast("int")


def complexity(source: Column) -> Column:
    """One plus the branch tokens of the lower-cased source; 1 for null or blank."""
    low = F.lower(F.coalesce(source, F.lit("")))
    return reduce(lambda a, t: a + occurrences(low, t), BRANCHES, F.lit(1))


def version_key(version: Column, width: int = 6) -> Column:
    """A comparable key: numeric parts padded to ``width``, then 0 with a qualifier and 1 without; blank is least."""
    v = F.trim(F.coalesce(version, F.lit("")))
    numbers = F.transform(F.split(F.substring_index(v, "-", 1), r"\."), lambda p: F.coalesce(F.when(p.rlike(r"^\d{1,9}$"), p.cast("int")), F.lit(0)))
    padded = F.slice(F.concat(numbers, F.array_repeat(F.lit(0), width)), 1, width)
    return F.when(v == "", F.array_repeat(F.lit(-1), width + 1)).otherwise(F.concat(padded, F.array(F.when(v.contains("-"), 0).otherwise(1))))


def simple_method(qualified_name: Column) -> Column:
    """``Class#method`` of a qualified name, without package and parameters."""
    owner = F.element_at(F.split(F.substring_index(qualified_name, "#", 1), r"\."), -1)
    return F.concat(owner, F.lit("#"), F.substring_index(F.substring_index(qualified_name, "#", -1), "(", 1))


def sink_name(text: Column) -> Column:
    """The method in ``SINK:method.arg[0]``."""
    return F.substring_index(F.regexp_replace(F.coalesce(text, F.lit("")), "^SINK:", ""), ".", 1)


def redact(text: Column) -> Column:
    """Secrets replaced: values after sensitive keys, and bearer tokens."""
    keyed = F.regexp_replace(text, r"(?i)\b(password|passwd|secret|token|api[_-]?key|access[_-]?key)(\s*[:=]\s*)(\"[^\"]*\"|'[^']*'|[^\s,;]+)", "$1$2[REDACTED]")
    return F.regexp_replace(keyed, r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]")


def glob_pattern(glob: Column) -> Column:
    """A glob as an anchored pattern: ``**`` crosses folders, ``*`` and ``?`` don't."""
    quoted = F.regexp_replace(glob, r"([.\\+^$|(){}\[\]])", r"\\$1")
    starred = F.replace(F.replace(F.replace(quoted, F.lit("**"), F.lit("\x01")), F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    return F.concat(F.lit("^"), F.replace(starred, F.lit("\x01"), F.lit(".*")), F.lit("$"))


def ipv4(text: Column) -> Column:
    """An IPv4 address as a number, null for anything else."""
    parts = F.split(text, r"\.")
    valid = text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    number = reduce(lambda a, i: a * 256 + F.get(parts, F.lit(i)).cast("long"), range(1, 4), F.get(parts, F.lit(0)).cast("long"))
    within = F.forall(parts, lambda p: F.try_to_number(p, F.lit("999")) <= 255)
    return F.when(valid & within, number)


def in_cidr(address: Column, entry: Column) -> Column:
    """Whether an entry (address or address/bits) holds the address; names only match themselves."""
    base, bits = F.substring_index(entry, "/", 1), F.regexp_extract(entry, r"/(\d{1,2})$", 1)
    size = F.pow(F.lit(2.0), F.lit(32) - F.when(bits == "", F.lit(32)).otherwise(bits.cast("int"))).cast("long")
    return (address == entry) | F.coalesce(entry.contains("/") & (F.floor(ipv4(address) / size) == F.floor(ipv4(base) / size)), F.lit(False))


def severity(text: Column) -> Column:
    """The severity scale for the spellings of scanners."""
    word = F.replace(F.upper(F.trim(F.coalesce(text, F.lit("")))), F.lit("-"), F.lit("_"))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for level, words in SEVERITIES.items() for w in words for x in (w, level)]), word), F.lit("UNKNOWN"))


def cwe(text: Column) -> Column:
    """The first ``CWE-<digits>`` of a text, null without one."""
    digits = F.regexp_extract(F.upper(F.coalesce(text, F.lit(""))), r"CWE[-_](\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("CWE-"), digits))


def short_hash(*parts: Column, between: str = ":") -> Column:
    """The first 16 hex digits of SHA-256 over the joined parts."""
    return F.substring(F.sha2(F.concat_ws(between, *parts), 256), 1, 16)


def route_path(part: Column) -> Column:
    """A route with one leading slash, single slashes inside and none at the end."""
    p = F.replace(F.trim(F.coalesce(part, F.lit(""))), F.lit("\\"), F.lit("/"))
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(p, "/{2,}", "/"), "^/|/$", ""))


def joined_route(outer: Column, inner: Column) -> Column:
    """The route of a method under its class."""
    a, b = route_path(outer), route_path(inner)
    return F.when(a == "/", b).when(b == "/", a).otherwise(F.concat(a, b))


def short_package(name: Column) -> Column:
    """The last two segments of a package."""
    return F.substring_index(name, ".", -2)


def purl(ecosystem: Column, group: Column, name: Column, version: Column) -> Column:
    """A package address for Maven, npm and PyPI."""
    at = F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit("@"), version)).otherwise("")
    npm = F.concat(F.lit("pkg:npm/"), F.replace(name, F.lit("@"), F.lit("%40")), at)
    pypi = F.concat(F.lit("pkg:pypi/"), F.replace(F.lower(name), F.lit("_"), F.lit("-")), at)
    return F.when(ecosystem == "npm", npm).when(ecosystem == "pip", pypi).otherwise(F.concat(F.lit("pkg:maven/"), group, F.lit("/"), name, at))


def filled(template: Column, count: Column, groups: Column) -> Column:
    """A template with {count} and {1}, {2}, ... replaced."""
    start = F.replace(template, F.lit("{count}"), count.cast("string"))
    return F.aggregate(F.transform(groups, lambda g, i: F.struct((i + 1).alias("i"), F.coalesce(g, F.lit("")).alias("g"))), start, lambda t, x: F.replace(t, F.concat(F.lit("{"), x["i"].cast("string"), F.lit("}")), x["g"]))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def doc_summary(source: Column) -> Column:
    """The first sentence of the first documentation comment (else of the first block comment), or its first lines up to 120 characters."""
    text = F.coalesce(source, F.lit(""))
    doc = F.instr(text, "/**")
    start = F.when(doc > 0, doc).otherwise(F.instr(text, "/*"))
    rest = F.substring(text, start + 2, F.length(text))
    end = F.instr(rest, "*/")
    block = F.when((start > 0) & (end > 0), F.substring(rest, F.lit(1), end - 1)).otherwise("")
    lines = F.transform(F.split(block, "\n"), lambda x: _stripped(F.regexp_replace(x, r"^\s*\*?\s?", "")))
    told = F.filter(lines, lambda x: (x != "") & ~x.startswith("@") & (x != "*"))

    def step(acc: Column, line: Column) -> Column:
        grown = F.when(acc["text"] == "", line).otherwise(F.concat(acc["text"], F.lit(" "), line))
        dot = F.instr(grown, ".")
        cut = F.when(dot > 0, F.substring(grown, F.lit(1), dot)).otherwise(grown)
        over = (dot > 0) | (F.length(grown) >= 120)
        return F.struct(F.when(acc["over"], acc["text"]).otherwise(cut).alias("text"), (acc["over"] | over).alias("over"))

    return _stripped(F.aggregate(told, F.struct(F.lit("").alias("text"), F.lit(False).alias("over")), step)["text"])


def regression_ok(kind: Column, pattern: Column, positive: Column, negative: Column) -> Column:
    """Whether a rule matches all its positive samples and none of its negative ones."""
    hit = lambda s: F.when(kind == "SUBSTRING", s.contains(pattern)).otherwise(F.rlike(s, F.concat(F.lit("(?s)"), pattern)))
    return F.forall(positive, hit) & ~F.exists(negative, hit)


#: Annotations of HTTP entries, and of parameters and types that carry user input or never do.
ENTRY_MARKS = ("@requestmapping", "@getmapping", "@postmapping", "@putmapping", "@deletemapping", "@patchmapping")
INPUT_MARKS = ("@requestparam", "@pathvariable", "@requestbody", "@requestheader", "@matrixvariable", "@modelattribute")
INPUT_TYPES = ("httpservletrequest", "servletrequest", "multipartfile", "multipartrequest", "servletwebexchange")
OUTPUT_TYPES = ("httpservletresponse", "servletresponse", "model", "modelandview", "bindingresult", "errors", "redirectattributes", "sessionstatus")


def is_http_entry(source: Column) -> Column:
    low = F.lower(F.coalesce(source, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(m) for m in ENTRY_MARKS])


def user_parameters(signature: Column) -> Column:
    """Indices of parameters that a user controls: marked ones, else all that aren't outputs."""
    inside = F.regexp_extract(F.lower(F.coalesce(signature, F.lit(""))), r"\((.*)\)", 1)
    params = F.transform(F.filter(F.split(inside, r",(?![^<]*>)"), lambda p: F.trim(p) != ""), lambda p, i: F.struct(F.trim(p).alias("p"), i.alias("i")))
    has = lambda text, words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    kind = lambda p: F.regexp_extract(F.regexp_replace(p, r"@\w+(\([^)]*\))?\s*", ""), r"^(?:final\s+)?(\S+)", 1)
    marked = F.filter(params, lambda x: has(x["p"], INPUT_MARKS) | has(kind(x["p"]), INPUT_TYPES))
    rest = F.filter(params, lambda x: ~has(kind(x["p"]), OUTPUT_TYPES))
    return F.transform(F.when(F.size(marked) > 0, marked).otherwise(rest), lambda x: x["i"])
