"""Retrieval: vector and keyword search, security-aware scores, graph expansion, context packs, evaluation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.code import doc_summary, occurrences
from graphlens.operators.graph import IMPACT_KINDS, least_ancestors, reach
from graphlens.plans.lineage import cut

CANDIDATES = 5000
EXPAND_PER_SEED = 20
IMPACT_SEEDS = 3
IMPACT_PER_SEED = 20

#: Words that carry no search term.
STOP_WORDS = ("the", "and", "for", "with", "from", "this", "that", "into", "where", "what", "when", "how", "why", "是否", "这个", "那个")

#: Names, annotations and source texts that raise the security score.
HIGH_NAMES = (
    "authenticate", "authorize", "login", "logout", "verifytoken", "validatetoken", "checkpermission", "haspermission", "isauthorized", "isallowed", "checkaccess",
    "grantaccess", "executequery", "executebatch", "preparestatement", "getruntime", "processbuilder", "deserialize", "readobject", "fromjson",
)
MEDIUM_NAMES = (
    "encrypt", "decrypt", "cipher", "signcontent", "verifysignature", "validate", "sanitize", "escapeinput", "filterinput", "password", "secret", "credential",
    "apikey", "privatekey", "accesstoken", "refreshtoken", "jwtoken", "oauthtoken", "sessionid",
)
HIGH_ANNOTATIONS = ("@preauthorize", "@postauthorize", "@secured", "@rolesallowed", "@presecure", "@postsecure", "@withsecuritycontext")
LOW_ANNOTATIONS = ("@crossorigin", "@requestbody", "@requestparam", "@pathvariable")
SQL_SOURCES = ("preparedstatement", ".executequery(", ".executeupdate(")
CRYPTO_SOURCES = ("messagedigest", "cipher.getinstance(", '"md5"', '"sha-1"')
COMMAND_SOURCES = ("runtime.getruntime().exec(", "new processbuilder(")


def payload_filter(language: str | None = None, kind: str | None = None, project_id: str | None = None, allowed: list[str] | None = None, entry_only: bool = False, no_test: bool = False) -> Column:
    """All given conditions; an empty list of allowed projects lets nothing through."""
    parts = [F.lit(True)]
    for name, value in (("language", language), ("kind", kind), ("project_id", project_id)):
        if value:
            parts.append(F.col(name) == value)
    if allowed is not None:
        parts.append(F.col("project_id").isin(*allowed) if allowed else F.lit(False))
    if entry_only:
        parts.append(F.col("is_entry_point"))
    if no_test:
        parts.append(~F.coalesce(F.col("is_test"), F.lit(False)))
    return reduce(lambda a, b: a & b, parts)


def locate(units: DataFrame, file_path: str, line: int, project_id: str) -> DataFrame:
    """The unit at a line: of several the one with the fewest lines, then the least id."""
    at = units.filter((F.col("project_id") == project_id) & (F.col("file_path") == file_path) & F.lit(line).between(F.col("start_line"), F.col("end_line")))
    return at.orderBy(F.col("end_line") - F.col("start_line"), "id").limit(1)


def find_symbols(units: DataFrame, text: str, project_id: str, limit: int = 10) -> DataFrame:
    """Units whose name holds ``text``: exact names first, then endings, then other places, then simple names."""
    want, name, simple = text.lower(), F.lower("qualified_name"), F.lower("simple_name")
    rank = F.when(name == want, 0).when(name.endswith(want), 1).when(name.contains(want), 2).when(simple.contains(want), 3)
    found = units.filter(F.col("project_id") == project_id).withColumn("rank", rank).filter("rank IS NOT NULL")
    one = found.withColumn("r", F.row_number().over(Window.partitionBy("qualified_name").orderBy("rank", "id"))).filter("r = 1")
    return one.orderBy("rank", F.length("qualified_name"), "qualified_name").limit(max(1, min(limit, 50)))


def symbol(units: DataFrame, qualified_name: str, project_id: str | None = None) -> DataFrame:
    """The unit of that very name: of several the first by file, then by id."""
    own = units.filter(F.col("qualified_name") == qualified_name)
    if project_id is not None:
        own = own.filter(F.col("project_id") == project_id)
    return own.orderBy("file_path", "id").limit(1)


#: Kinds that stand for a type, and the length of a document's text.
CLASS_KINDS = ("CLASS", "INTERFACE", "ENUM", "ANNOTATION")
DOCUMENT_CHARS = 1024


def semantic_text(units: DataFrame) -> DataFrame:
    """(id, semantic_text): a document's first characters; of other units what their class says of itself (summary of its
    comment, annotations, signature; of several of one name the least id), then the same of their own."""
    said = lambda source, marks, signature: F.concat(
        F.when(doc_summary(source) != "", F.concat(doc_summary(source), F.lit(". "))).otherwise(""),
        F.when(F.coalesce(marks, F.lit("")) != "", F.concat(F.replace(marks, F.lit(","), F.lit(" ")), F.lit(" "))).otherwise(""), F.coalesce(signature, F.lit("")),
    )
    top = units.filter(F.col("kind").isin(*CLASS_KINDS)).groupBy("project_id", F.col("qualified_name").alias("parent_qualified_name")).agg(F.min_by(F.struct("raw_source", "annotations", "signature"), "id").alias("p"))
    both = units.join(top, ["project_id", "parent_qualified_name"], "left")
    above = F.when(~F.col("kind").isin(*CLASS_KINDS) & F.col("p").isNotNull(), F.concat(said(F.col("p.raw_source"), F.col("p.annotations"), F.col("p.signature")), F.lit(" "))).otherwise("")
    own = F.concat(above, said(F.col("raw_source"), F.col("annotations"), F.col("signature")))
    text = F.when(F.col("kind") == "DOCUMENT", F.substring(F.trim(F.coalesce("raw_source", F.lit(""))), 1, DOCUMENT_CHARS)).otherwise(F.trim(own))
    return both.select("id", text.alias("semantic_text"))


def search_targets(units: DataFrame, project_id: str | None = None, language: str | None = None, kind: str | None = None, no_test: bool = True, limit: int = CANDIDATES) -> DataFrame:
    """Candidates of keyword search in order of file and line."""
    own = units.filter(payload_filter(language, kind, project_id, no_test=no_test)).filter(F.trim(F.coalesce("raw_source", F.lit(""))) != "")
    return own.orderBy("file_path", "start_line", "id").limit(max(1, min(limit, 10_000)))


def terms_of(text: str) -> list[str]:
    """Search terms of a query, distinct and in order."""
    words = [t.strip() for t in re.split(r"[^A-Za-z0-9_.$#/-]+", text.lower())]
    return list(dict.fromkeys(t for t in words if len(t) >= 2 and t not in STOP_WORDS))


def query_terms(text: Column) -> Column:
    """The terms of ``terms_of`` for a column of texts."""
    words = F.split(F.lower(text), r"[^A-Za-z0-9_.$#/-]+")
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) >= 2) & ~w.isin(*STOP_WORDS)))


def keyword_score(terms: list[str]) -> Column:
    """0 to 1: weighted hits of the terms in names and signature, and their occurrences in the source, less for long sources."""

    def held(column: str, term: str, weight: float) -> Column:
        text = F.lower(F.coalesce(column, F.lit("")))
        return F.when(F.trim(text) == "", 0.0).when(text == term, 2 * weight).when(text.endswith(term), 1.5 * weight).when(text.contains(term), weight).otherwise(0.0)

    source = F.lower(F.coalesce("raw_source", F.lit("")))
    total = F.lit(0.0)
    for t in terms:
        total += held("qualified_name", t, 6.0) + held("simple_name", t, 8.0) + held("signature", t, 4.0) + occurrences(source, t)
    return F.least(F.lit(1.0), total / (10 * (1 + F.log10(F.greatest(F.lit(10), F.char_length(source)))))).cast("float")


def keyword_search(units: DataFrame, text: str, limit: int = 10, **filters) -> DataFrame:
    """The best units for a text, with score."""
    terms = terms_of(text)
    if not terms:
        return units.withColumn("score", F.lit(0.0).cast("float")).limit(0)
    return search_targets(units, **filters).withColumn("score", keyword_score(terms)).filter("score > 0").orderBy(F.desc("score"), "qualified_name", "id").limit(max(1, min(limit, 100)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_search(units: DataFrame, column: str, query: list[float], limit: int = 10, offset: int = 0, where: Column | None = None) -> DataFrame:
    """Exact top of the units by cosine to ``query``; the filter comes before any score."""
    own = units if where is None else units.filter(where)
    scored = own.withColumn("score", cosine(F.col(column), F.array(*[F.lit(float(x)) for x in query])))
    return scored.filter("score IS NOT NULL").orderBy(F.desc("score"), "id").offset(offset).limit(limit)


def security_score(annotations: Column | str = "annotations") -> Column:
    """0 to 1 from entry points, annotations, names and sources."""
    name, full = F.lower(F.coalesce("simple_name", F.lit(""))), F.lower(F.coalesce("qualified_name", F.lit("")))
    source = F.lower(F.coalesce("raw_source", F.lit("")))
    marks = F.filter(F.split(F.lower(F.coalesce(annotations, F.lit(""))), ","), lambda a: a != "")
    any_of = lambda text, words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    high, medium = any_of(name, HIGH_NAMES), any_of(name, MEDIUM_NAMES) | any_of(full, ["." + w for w in MEDIUM_NAMES])
    first = lambda words, k: reduce(lambda a, w: a.when(name.contains(w), F.lit(w)), words[1:], F.when(name.contains(words[0]), F.lit(words[0])))
    named = F.coalesce(first(HIGH_NAMES, 0), F.lit(""))
    points = F.when(F.col("is_entry_point"), 0.1).otherwise(0.0)
    points += 0.3 * F.size(F.filter(marks, lambda a: any_of(a, HIGH_ANNOTATIONS))) + 0.1 * F.size(F.filter(marks, lambda a: any_of(a, LOW_ANNOTATIONS)))
    points += F.when(high, 0.3).otherwise(0.0) + F.when(medium, 0.2).otherwise(0.0)
    points += F.when(any_of(source, SQL_SOURCES) & (named != "preparestatement"), 0.3).otherwise(0.0)
    points += F.when(any_of(source, CRYPTO_SOURCES), 0.2).otherwise(0.0)
    points += F.when(any_of(source, COMMAND_SOURCES) & ~named.isin("getruntime", "processbuilder"), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), points)


def graph_rag(units: DataFrame, edges: DataFrame, vector_column: str, query: list[float], text: str, seeds: int = 5, depth: int = 1, project_id: str | None = None, rerank: bool = True, call_graph: bool = True, impact: bool = True) -> DataFrame:
    """Hybrid retrieval: (qualified_name, id, source, relation, security, score, place).

    Vector seeds, then keyword seeds, then callers and callees of each vector seed, then security-relevant units that
    the first seeds have an impact on; a name stays with what brought it first.  All seeds are expanded together: the
    frontier carries the seed's number.  Lists cut at a limit are taken in order of name.
    """
    where = payload_filter(project_id=project_id, no_test=True)
    known = units.withColumn("security", security_score())
    bonus = 0.5 * F.col("security") if rerank else F.lit(0.0)
    found = vector_search(known, vector_column, query, seeds, where=where).withColumn("seed", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    vectors = cut(found.select("id", "qualified_name", "security", F.col("score").alias("base"), "seed"))
    place = lambda stage, *keys: F.struct(F.lit(stage).alias("stage"), *keys)
    row = ("qualified_name", "id", "source", "relation", "security", "score", "place")
    out = [vectors.select("qualified_name", "id", F.lit("VECTOR").alias("source"), F.lit("SEED").alias("relation"), "security", (F.col("base") + bonus).alias("score"), place(0, F.col("seed").alias("a"), F.lit(0).alias("b"), F.col("qualified_name").alias("c")).alias("place"))]
    words = cut(keyword_search(known, text, seeds, project_id=project_id).select("id", "qualified_name", "security", "score"))
    out.append(words.select("qualified_name", "id", F.lit("KEYWORD").alias("source"), F.lit("SEED").alias("relation"), "security", (F.col("score") + bonus).alias("score"), place(1, (-F.col("score")).cast("int").alias("a"), F.lit(0).alias("b"), F.col("qualified_name").alias("c")).alias("place")))
    scoped = known.filter(payload_filter(project_id=project_id))
    if call_graph:
        calls = edges.filter("kind = 'CALLS'").select("src", "dst").distinct()
        for k, (relation, links, factor) in enumerate((("CALLER", calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")), 0.6), ("CALLEE", calls, 0.5))):
            near = vectors.select("seed", "base", F.col("id").alias("src"))
            step, all_ = near, None
            for _ in range(max(1, min(depth, 3))):
                step = step.join(links, "src").select("seed", "base", F.col("dst").alias("src")).distinct()
                all_ = step if all_ is None else all_.unionByName(step).distinct()
            hit = all_.withColumnRenamed("src", "id").join(scoped, "id")
            top = hit.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("qualified_name", "id"))).filter(F.col("n") <= EXPAND_PER_SEED)
            out.append(top.select("qualified_name", "id", F.lit("CALL_GRAPH").alias("source"), F.lit(relation).alias("relation"), "security", (factor * F.col("base") + bonus).alias("score"), place(2, F.col("seed").alias("a"), F.lit(k).alias("b"), F.col("qualified_name").alias("c")).alias("place")))
    best = lambda df: df.groupBy("qualified_name").agg(F.min_by(F.struct(*row[1:]), "place").alias("x")).select("qualified_name", "x.*")
    got = cut(best(reduce(DataFrame.unionByName, out)))
    if impact:
        links = edges.filter(F.col("kind").isin(*IMPACT_KINDS)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        first = min(seeds, IMPACT_SEEDS)
        touched = reach(links, vectors.filter(F.col("seed") <= first).select("seed", "id"), None, "seed")
        relevant = cut(touched.join(scoped.filter("security > 0").select("id", "qualified_name", "security"), "id").select("seed", "id", "qualified_name", "security"))
        for s in range(1, first + 1):  # a name stays with the seed that brought it first
            new = relevant.filter(F.col("seed") == s).join(got, "qualified_name", "left_anti")
            one = new.groupBy("qualified_name").agg(F.min_by(F.struct("id", "security"), "id").alias("u")).select("qualified_name", "u.*").orderBy("qualified_name").limit(IMPACT_PER_SEED)
            more = one.select("qualified_name", "id", F.lit("IMPACT").alias("source"), F.lit("IMPACT").alias("relation"), "security", (0.2 + bonus).alias("score"), place(3, F.lit(s).alias("a"), F.lit(0).alias("b"), F.col("qualified_name").alias("c")).alias("place"))
            got = cut(got.unionByName(more))
    return got.orderBy(F.desc("score"), "place") if rerank else got.orderBy("place")


def context_pack(ranked: DataFrame, budget: int = 12_000) -> DataFrame:
    """Ranked candidates (rank, id, text) cut to a budget of characters: rank, id, excerpt, citation, truncated.

    Each takes at most its share (budget over the first up to four with text) and what is left of the budget; blank texts
    take nothing.  Ranks are those of one query's result, so the running sum is over a short list.
    """
    budget = max(1000, min(budget, 60_000))
    own = ranked.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).filter("text <> ''")
    share = F.floor(F.lit(budget) / F.greatest(F.lit(1), F.least(F.lit(4), F.count("*").over(Window.partitionBy()))))
    size = own.withColumn("cap", share).withColumn("take", F.least(F.char_length("text"), F.col("cap")))
    before = F.coalesce(F.sum("take").over(Window.orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = size.withColumn("room", F.least(F.col("cap"), budget - before)).filter("room > 0")
    return left.select("rank", "id", F.substring("text", F.lit(1), F.col("room").cast("int")).alias("excerpt"), F.concat(F.lit("C"), F.row_number().over(Window.orderBy("rank", "id")).cast("string")).alias("citation"), (F.char_length("text") > F.col("room")).alias("truncated"))


def evaluate(results: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """hit@k, mean reciprocal rank and mean top score from (case_id, rank, relevant, score); a case without a hit counts 0."""
    case = results.groupBy("case_id").agg(F.min(F.when(F.col("relevant") & (F.col("rank") <= max(cutoffs)), F.col("rank"))).alias("first"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"))
    hits = [F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in cutoffs]
    return case.agg(F.count("*").alias("cases"), *hits, F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg("top").alias("mean_top"))


def _dependents(links: DataFrame, marks: DataFrame, k: int) -> DataFrame:
    """(id, mark): the ``k`` least marks of the units that depend on each unit, from links (src: what is depended on, dst)."""
    return least_ancestors(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")), marks, k)


def finding_context(findings: DataFrame, units: DataFrame, edges: DataFrame, impact_units: int = IMPACT_PER_SEED) -> DataFrame:
    """(finding_id, qualified_name, relation, score) of located findings (finding_id, unit_id): the unit itself, then its
    callers and callees at one step (up to 20 each, by name), then the first ``impact_units`` security-relevant units, by
    name, that depend on it at any distance.  All this is found once a unit, however many findings it has.
    """
    known = units.withColumn("security", security_score())
    own = findings.filter("unit_id IS NOT NULL").select(F.col("unit_id").alias("id")).distinct().withColumn("unit_id", F.col("id"))
    calls = edges.filter("kind = 'CALLS'").select("src", "dst").distinct()
    named = known.select("id", "qualified_name", "security")
    parts = [own.join(named, "id").select("unit_id", "qualified_name", F.lit(0).alias("stage"), F.lit("FINDING").alias("relation"), (1.0 + 0.5 * F.col("security")).alias("score"))]
    callers = own.withColumnRenamed("id", "dst").join(calls, "dst").select("unit_id", F.col("src").alias("id"))
    callees = own.withColumnRenamed("id", "src").join(calls, "src").select("unit_id", F.col("dst").alias("id"))
    for stage, (relation, near, base) in enumerate((("CALLER", callers, 0.6), ("CALLEE", callees, 0.5)), 1):
        hit = near.distinct().join(named, "id").withColumn("r", F.row_number().over(Window.partitionBy("unit_id").orderBy("qualified_name", "id"))).filter(F.col("r") <= EXPAND_PER_SEED)
        parts.append(hit.select("unit_id", "qualified_name", F.lit(stage).alias("stage"), F.lit(relation).alias("relation"), (base + 0.5 * F.col("security")).alias("score")))
    near = cut(reduce(DataFrame.unionByName, parts))
    links = edges.filter(F.col("kind").isin(*IMPACT_KINDS)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    marks = named.filter("security > 0").select(F.col("id"), F.struct("qualified_name", F.col("id").alias("unit")).alias("mark"))
    # dependents by name: those that stand nearer already are passed over, so a unit may need that many more
    dependents = _dependents(links, marks, impact_units + 2 * EXPAND_PER_SEED + 1)
    more = own.join(dependents, "id").select("unit_id", "mark.qualified_name", F.col("mark.unit").alias("id")).join(near.select("unit_id", "qualified_name"), ["unit_id", "qualified_name"], "left_anti")
    top = more.join(named.select("id", "security"), "id").withColumn("r", F.row_number().over(Window.partitionBy("unit_id").orderBy("qualified_name", "id"))).filter(F.col("r") <= impact_units)
    every = near.unionByName(top.select("unit_id", "qualified_name", F.lit(3).alias("stage"), F.lit("IMPACT").alias("relation"), (0.2 + 0.5 * F.col("security")).alias("score")))
    first = lambda df, key: df.groupBy(key, "qualified_name").agg(F.min(F.struct("stage", "relation", "score")).alias("x")).select(key, "qualified_name", "x.*")
    once = first(every, "unit_id")
    # a finding of one unit has that unit's rows; only the others are put together once more
    rows = findings.filter("unit_id IS NOT NULL").groupBy("finding_id").agg(F.min("unit_id").alias("unit_id"), F.max("unit_id").alias("last"), F.collect_set("unit_id").alias("all"))
    alone = rows.filter("unit_id = last").select("finding_id", "unit_id").join(once, "unit_id")
    several = first(rows.filter("unit_id <> last").select("finding_id", F.explode("all").alias("unit_id")).join(once, "unit_id"), "finding_id")
    names = ("finding_id", "qualified_name", "relation", "score")
    return alone.select(*names).unionByName(several.select(*names))
