"""Graph operators: edge resolution, bounded and unbounded reachability, coverage gaps, cascades, cycles.

Units: id, project_id, kind, qualified_name, simple_name, file_path, start_line, end_line, ...; edges: src, dst, kind.
Loops keep the edges partitioned by their source for as long as they run, so that a step moves its frontier and never
the edges, and append what they find to one table of visited nodes: a step costs what its frontier reaches and an
executor's loss costs a step at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from graphlens.plans.lineage import Visited, cut

MAX_DEPTH = 50
IMPACT_KINDS = ("CALLS", "DEFINES_TYPE", "OVERRIDES", "EXTENDS", "IMPLEMENTS")


def arity(qualified_name: Column) -> Column:
    """Number of parameters between the first parentheses; null without them."""
    inside = F.regexp_extract(qualified_name, r"\(([^)]*)\)", 1)
    return F.when(~qualified_name.contains("("), F.lit(None)).when(F.trim(inside) == "", 0).otherwise(F.size(F.split(inside, ",")))


def resolve_edges(raw: DataFrame, units: DataFrame) -> DataFrame:
    """Resolved, merged relations (src, dst, kind, file_path, source_line, project_id).

    A target is an id, else a qualified name, else the only unit of that base name (and arity, where given) in the
    project of the source; what fits nothing is dropped; of parallel relations the last (by seq) gives file and line.
    """
    own = units.select("id", "project_id", "qualified_name")
    base = F.regexp_replace("target_ref", r"::arity=\d+$", "")
    wanted = F.regexp_extract("target_ref", r"::arity=(\d+)$", 1)
    rows = raw.join(own.select(F.col("id").alias("source_id"), "project_id"), "source_id").withColumns({"base": base, "arity": F.when(wanted != "", wanted.cast("int"))})
    refs = rows.select("project_id", "target_ref", "base", "arity").distinct()
    by_id = refs.join(own.select("project_id", F.col("id").alias("target_ref")), ["project_id", "target_ref"]).select("project_id", "target_ref", F.col("target_ref").alias("dst"), F.lit(0).alias("rank"))
    by_name = refs.join(own.select("project_id", F.col("qualified_name").alias("target_ref"), F.col("id").alias("dst")), ["project_id", "target_ref"]).groupBy("project_id", "target_ref").agg(F.min("dst").alias("dst")).withColumn("rank", F.lit(1))
    named = own.filter(F.col("qualified_name").contains("(")).select("project_id", F.substring_index("qualified_name", "(", 1).alias("base"), F.col("id").alias("dst"), arity(F.col("qualified_name")).alias("has"))
    by_base = (
        refs.join(named, ["project_id", "base"]).filter(F.col("arity").isNull() | (F.col("arity") == F.col("has")))
        .groupBy("project_id", "target_ref").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).filter("n = 1").select("project_id", "target_ref", "dst", F.lit(2).alias("rank"))
    )
    best = by_id.unionByName(by_name).unionByName(by_base).groupBy("project_id", "target_ref").agg(F.min_by("dst", "rank").alias("dst"))
    found = rows.join(best, ["project_id", "target_ref"])
    last = F.max_by(F.struct("file_path", "source_line"), F.struct("seq", "source_line", "file_path")).alias("last")
    return found.groupBy(F.col("source_id").alias("src"), "dst", "kind", "project_id").agg(last).select("src", "dst", "kind", "last.file_path", "last.source_line", "project_id")


def start_set(units: DataFrame, edges: DataFrame, qualified_name: str, project_id: str | None = None) -> DataFrame:
    """(id) of all units of that name, and what they contain on one level."""
    own = units.filter(F.col("qualified_name") == qualified_name)
    if project_id is not None:
        own = own.filter(F.col("project_id") == project_id)
    own = own.select("id")
    return own.unionByName(edges.filter("kind = 'CONTAINS'").join(own, edges["src"] == own["id"]).select(F.col("dst").alias("id"))).distinct()


def held(links: DataFrame, *keys: str) -> DataFrame:
    """``links`` partitioned by ``keys`` for a loop; the caller unpersists them after its last step is written."""
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return links.repartition(n, *keys).persist()


def reach(edges: DataFrame, start: DataFrame, depth: int | None = None, *keys: str) -> DataFrame:
    """(keys, id, depth) of the nodes reached from ``start`` along edges (src, dst) by 1..depth steps; depth None: all.

    The start is not visited beforehand: it is in the result if a cycle leads back to it within the depth.  With
    ``keys``, columns of ``start``, the starts of each key go forward by themselves, all in the same steps.
    """
    links = held(edges.select("src", "dst").distinct(), "src")
    visited = Visited(start.select(*keys, "id", F.lit(0).alias("depth")))
    step, grew = 0, 1
    while grew and (depth is None or step < depth):
        frontier = visited.rows().filter(F.col("depth") == step).select(*keys, F.col("id").alias("src"))
        step += 1
        met = links.join(frontier, "src", "inner" if keys else "left_semi")
        new = met.select(*keys, F.col("dst").alias("id")).distinct()
        grew = visited.add(new.join(visited.rows().filter("depth > 0").select(*keys, "id"), [*keys, "id"], "left_anti").withColumn("depth", F.lit(step)))
    links.unpersist()
    return visited.rows().filter("depth > 0")


#: Marks that a word of a mask stands for.
WORD = 63


def least_ancestors(edges: DataFrame, marked: DataFrame, k: int) -> DataFrame:
    """(id, mark): for each node the ``k`` least marks of the marked nodes (id, mark) that reach it along edges (src, dst).

    First the least marks of all go forward together, each a bit of a mask.  Where ``k`` of them come to, no other mark
    matters, and so it is in all that follows from there.  Only the rest of the graph, where no way leads from such a
    node, passes on marks themselves: its ``k`` least at each node, since one that ``k`` lesser ones precede here does so
    wherever both lead.
    """
    links = held(edges.select("src", "dst").distinct(), "src")
    n = -(-2 * k // WORD)  # twice the marks that are kept: some of the least may not lead to a node that all others lead to
    least = marked.join(links.select(F.col("src").alias("id")), "id", "left_semi").select("mark").distinct().orderBy("mark").limit(WORD * n)
    spark, kind = links.sparkSession, marked.schema["mark"].dataType
    bits = spark.createDataFrame([(i, r[0]) for i, r in enumerate(least.collect())], StructType([StructField("bit", IntegerType()), StructField("mark", kind)]))
    words = [f"w{i}" for i in range(n)]
    own = marked.join(F.broadcast(bits), "mark")
    some = [F.bit_or(F.when(F.floor(F.col("bit") / WORD) == i, F.expr(f"shiftleft(1L, bit % {WORD})")).otherwise(F.lit(0).cast("long"))).alias(w) for i, w in enumerate(words)]
    met = links.join(own.groupBy(F.col("id").alias("src")).agg(*some), "src")
    every = lambda df: df.groupBy("id").agg(*[F.bit_or(w).alias(w) for w in words])
    masks, step = Visited(every(met.select(F.col("dst").alias("id"), *words)).withColumn("step", F.lit(0))), 0
    grew = masks.n
    while grew:
        frontier = masks.rows().filter(F.col("step") == step).select(F.col("id").alias("src"), *words)
        step += 1
        sent = every(links.join(frontier, "src").select(F.col("dst").alias("id"), *words))
        known = every(masks.rows()).withColumnsRenamed({w: f"k{w}" for w in words})
        new = sent.join(known, "id", "left").select("id", *[F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"k{w}", F.lit(0).cast("long")))).alias(w) for w in words])
        grew = masks.add(new.filter(reduce(lambda x, w: x | (F.col(w) != 0), words, F.lit(False))).withColumn("step", F.lit(step)))
    full = cut(every(masks.rows()).filter(reduce(lambda x, w: x + F.bit_count(w), words, F.lit(0)) >= k))
    there = F.flatten(F.array(*[F.expr(f"transform(filter(sequence(0, {WORD - 1}), x -> (shiftright({w}, x) & 1L) = 1L), x -> x + {WORD * i})") for i, w in enumerate(words)]))
    filled = full.select("id", F.explode(F.slice(there, 1, k)).alias("bit")).join(F.broadcast(bits), "bit").select("id", "mark")
    rest = held(links.join(full.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "src")
    links.unpersist()
    first = rest.join(marked.select(F.col("id").alias("src"), "mark"), "src").select(F.col("dst").alias("id"), "mark").distinct()
    by = Window.partitionBy("id").orderBy("mark")
    top = lambda df: df.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k).drop("r")
    state = cut(top(first).withColumn("fresh", F.lit(True)))
    while state.filter("fresh").limit(1).count():
        sent = rest.join(state.filter("fresh").select(F.col("id").alias("src"), "mark"), "src").select(F.col("dst").alias("id"), "mark").distinct()
        both = state.select("id", "mark", F.lit(False).alias("fresh")).unionByName(sent.withColumn("fresh", F.lit(True)))
        state = cut(top(both.groupBy("id", "mark").agg(F.min("fresh").alias("fresh"))))
    rest.unpersist()
    return state.select("id", "mark").unionByName(filled)


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def find_callers(units: DataFrame, edges: DataFrame, qualified_name: str, depth: int = 3, project_id: str | None = None) -> DataFrame:
    """Units with a chain of calls of length 1..depth into the named unit or its members."""
    if depth <= 0:
        return units.limit(0)
    found = reach(_reversed(edges.filter("kind = 'CALLS'")), start_set(units, edges, qualified_name, project_id), min(depth, MAX_DEPTH))
    return _of_project(units, project_id).join(found.select("id"), "id", "left_semi")


def find_callees(units: DataFrame, edges: DataFrame, qualified_name: str, depth: int = 3, project_id: str | None = None) -> DataFrame:
    """Units that the named unit or its members reach by 1..depth calls."""
    if depth <= 0:
        return units.limit(0)
    found = reach(edges.filter("kind = 'CALLS'"), start_set(units, edges, qualified_name, project_id), min(depth, MAX_DEPTH))
    return _of_project(units, project_id).join(found.select("id"), "id", "left_semi")


def impact(units: DataFrame, edges: DataFrame, qualified_name: str, project_id: str | None = None) -> DataFrame:
    """All units that depend on the named unit through calls, types, overrides and inheritance, at any distance."""
    found = reach(_reversed(edges.filter(F.col("kind").isin(*IMPACT_KINDS))), start_set(units, edges, qualified_name, project_id))
    return _of_project(units, project_id).join(found.select("id"), "id", "left_semi")


def subtypes(units: DataFrame, edges: DataFrame, qualified_name: str) -> DataFrame:
    """Units that extend or implement the named one directly."""
    own = units.filter(F.col("qualified_name") == qualified_name).select(F.col("id").alias("dst"))
    return units.join(edges.filter(F.col("kind").isin("EXTENDS", "IMPLEMENTS")).join(own, "dst", "left_semi").select(F.col("src").alias("id")), "id", "left_semi")


def _of_project(units: DataFrame, project_id: str | None) -> DataFrame:
    return units if project_id is None else units.filter(F.col("project_id") == project_id)


def scan_targets(units: DataFrame, project_id: str) -> DataFrame:
    """Callable units with a source."""
    return units.filter((F.col("project_id") == project_id) & F.col("kind").isin("METHOD", "CONSTRUCTOR", "FUNCTION") & (F.trim(F.coalesce("raw_source", F.lit(""))) != ""))


def test_gaps(units: DataFrame, edges: DataFrame, project_id: str, depth: int = 6) -> DataFrame:
    """Production methods whose name no test reaches within ``depth`` calls, in order of file and line."""
    tests = units.filter((F.col("project_id") == project_id) & F.col("is_test"))
    reached = reach(edges.filter("kind = 'CALLS'"), tests.select("id"), depth).select("id").unionByName(tests.select("id"))
    covered = units.join(reached, "id", "left_semi").select("qualified_name").distinct()
    return scan_targets(units, project_id).filter(~F.col("is_test")).join(covered, "qualified_name", "left_anti").orderBy("file_path", "start_line", "id")


def dead_code(units: DataFrame, edges: DataFrame, project_id: str, keep_entry_points: bool = False) -> DataFrame:
    """Methods and functions that nothing calls.  Entry points count as dead unless ``keep_entry_points``."""
    own = units.filter((F.col("project_id") == project_id) & F.col("kind").isin("METHOD", "FUNCTION"))
    if keep_entry_points:
        own = own.filter(~F.col("is_entry_point"))
    return own.join(edges.filter("kind = 'CALLS'").select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def delete_files(units: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units and edges without those of ``files`` (project_id, file_path): a unit takes its edges along."""
    gone = units.join(files, ["project_id", "file_path"], "left_semi").select("id")
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return units.join(gone, "id", "left_anti"), kept.select(*edges.columns)


def class_edges(units: DataFrame, edges: DataFrame, project_id: str) -> DataFrame:
    """Distinct (caller, callee) classes of calls between methods of different classes."""
    own = units.filter((F.col("project_id") == project_id) & F.col("qualified_name").contains("#")).select("id", F.substring_index("qualified_name", "#", 1).alias("class"))
    calls = edges.filter("kind = 'CALLS'").join(own.select(F.col("id").alias("src"), F.col("class").alias("caller")), "src").join(own.select(F.col("id").alias("dst"), F.col("class").alias("callee")), "dst")
    return calls.filter("caller <> callee").select("caller", "callee").distinct()


def package_of(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)


def package_edges(classes: DataFrame) -> DataFrame:
    """(src, dst, n) between different packages, from class edges (caller, callee)."""
    return classes.select(package_of(F.col("caller")).alias("src"), package_of(F.col("callee")).alias("dst")).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _on_ways(links: DataFrame) -> DataFrame:
    """Links between nodes that have a way in and a way out, also without the others."""
    before = -1
    while (now := links.count()) != before:
        before = now
        links = cut(links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
    return links


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of edges (src, dst) that lie on cycles of two or more; the component is its least id.

    Forward and backward colouring: each node takes the least node that reaches it as its colour; the nodes that a
    colour's own node is reached from, inside the colour, are a component.  The rest goes through the same again.
    """
    links = _on_ways(cut(edges.filter("src <> dst").select("src", "dst").distinct()))
    found: list[DataFrame] = []
    while links.limit(1).count():
        colours = cut(links.select(F.col("src").alias("id")).distinct().withColumn("colour", F.col("id")))
        changed = 1
        while changed:
            near = links.join(colours.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("near"))
            state = Visited(colours.join(near, "id").select("id", F.least("colour", "near").alias("now"), (F.col("near") < F.col("colour")).alias("fresh"))).rows()
            changed, colours = state.filter("fresh").limit(1).count(), state.select("id", F.col("now").alias("colour"))
        ends = lambda c: colours.select(F.col("id").alias(c), F.col("colour").alias(f"{c}_colour"))
        inner = links.join(ends("src"), "src").join(ends("dst"), "dst").filter("src_colour = dst_colour").select("src", "dst")
        roots = colours.filter("id = colour").select("id")
        back = reach(_reversed(inner), roots).select("id").unionByName(roots).distinct()
        own = cut(colours.join(back, "id").select("id", F.col("colour").alias("component")))
        found.append(own)
        gone = own.select("id")
        links = _on_ways(cut(links.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")))
    if not found:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    several = every.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    return every.join(several, "component", "left_semi").select("id", "component")


def cycles(edges: DataFrame) -> DataFrame:
    """Strongly connected components of two or more nodes of edges (src, dst), the largest first: (component, size, members)."""
    member = strong_components(edges)
    return member.groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_set("id")).alias("members")).orderBy(F.desc("size"), "component")


def rank_in(keys: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
