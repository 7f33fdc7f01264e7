"""Reachability over typed edges, chains, trees and one-hop neighbourhoods.

The frontier of a hop is joined with the edges and loses what was seen before, so the least depth falls out of the order of
hops and walks are never enumerated. Every hop is a stashed table; a start symbol on a cycle appears at the cycle's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernweave.functions.lineage import stash, unstash
from fernweave.plans.schema import Graph

DEFAULT_DEPTH, MAX_DEPTH = 5, 20
#: Hops after which the nodes seen so far become one table again.
COMPACT = 8
#: Pivots after one another before pairs are searched without a bound.
ROUNDS = 6
#: Edges that a graph may have with shortcuts: this many times its own, or this many.
SHORTCUTS, FEW = 6, 5_000_000


def clamp(depth: int | None) -> int:
    return DEFAULT_DEPTH if not depth or depth <= 0 else min(depth, MAX_DEPTH)


def hops(edges: DataFrame, starts: DataFrame, depth: int, seed: bool = False) -> DataFrame:
    """(start, node, depth) of all nodes reached from starts(start, node) over edges(a, b).

    seed: the start nodes themselves are reached at depth 0. depth 0: until nothing new is reached.
    """
    edges = stash(edges.select("a", "b").distinct())  # every hop reads it
    begin = stash(starts.select("start", "node", F.lit(0).alias("depth")).distinct())
    seen, frontier, parts, d = (begin if seed else begin.limit(0)), begin, [begin], 0
    while not depth or d < depth:
        d += 1
        step = frontier.join(edges, frontier["node"] == edges["a"]).select("start", F.col("b").alias("node")).distinct()
        new = stash(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.lit(d).alias("depth")))
        if new.isEmpty():
            unstash(new)
            break
        parts.append(new)
        seen, frontier = seen.union(new), new
        if len(parts) == COMPACT:  # many small tables make the plan long
            whole = stash(seen)
            unstash(*parts[1:-1])
            # what was seen holds all parts; the last one is the frontier still
            parts, seen = [begin, whole], whole
    unstash(edges)
    return seen


def _ends(edges: DataFrame, types: list[str], forward: bool) -> DataFrame:
    e = edges.where(F.col("edge_type").isin(types) & F.col("target_id").isNotNull())
    a, b = ("source_id", "target_id") if forward else ("target_id", "source_id")
    return e.select(F.col(a).alias("a"), F.col(b).alias("b"))


def reachable(graph: Graph, starts: DataFrame, depth: int | None = None, forward: bool = True) -> DataFrame:
    """Transitive callees (or callers) of many symbols at once, with details. starts: symbol_id."""
    begin = starts.select(F.col("symbol_id").alias("start"), F.col("symbol_id").alias("node"))
    found = hops(_ends(graph.edges, ["call"], forward), begin, clamp(depth))
    s = graph.symbols.select(F.col("symbol_id").alias("node"), "name", "kind", "file_id", "start_line")
    return found.join(s, "node").join(graph.files.select("file_id", "path"), "file_id", "left").select(
        F.col("start").alias("start_id"), F.col("node").alias("symbol_id"), "name", "kind", F.coalesce("path", F.lit("")).alias("path"), "start_line", "depth"
    )


def impact_tree(found: DataFrame) -> DataFrame:
    """Reached symbols by depth, names in order."""
    return found.groupBy("start_id", "depth").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("name")).alias("names"))


def render_impact(rows: list) -> str:
    lines = []
    for r in sorted(rows, key=lambda r: r["depth"]):
        lines.append(f"depth {r['depth']} ({r['n']})")
        lines += [f"{'  ' * r['depth']}- {name}" for name in r["names"]]
    return "\n".join(lines)


def _closure(edges: DataFrame, start: DataFrame, a: str, b: str) -> DataFrame:
    """(node): start and all that is reached from it over edges from column a to column b."""
    seen, frontier, parts = start, start, []
    while True:
        step = edges.join(frontier.select(F.col("node").alias(a)), a, "left_semi").select(F.col(b).alias("node")).distinct()
        new = stash(step.join(seen, "node", "left_anti"))
        if new.isEmpty():
            unstash(new)
            return seen
        parts.append(new)
        seen, frontier = seen.union(new), new
        if len(parts) == COMPACT:  # the last part is the frontier still
            seen = stash(seen)
            unstash(*parts[:-1])
            parts = [seen]


def _search(edges: DataFrame, pairs: DataFrame, most: int | None) -> DataFrame | None:
    """(chain_id) of the pairs whose end is reached; None if more than `most` rows are seen before all is known."""
    seen = frontier = pairs.select("chain_id", F.col("a").alias("node")).distinct()
    found, rows = pairs.select("chain_id").limit(0), 0
    while True:
        step = frontier.join(edges, F.col("node") == F.col("a")).select("chain_id", F.col("b").alias("node")).distinct()
        new = stash(step.join(seen, ["chain_id", "node"], "left_anti"))
        n = new.count()
        rows += n
        if not n or most is not None and rows > most:
            return None if n else found
        hit = stash(new.join(pairs.select("chain_id", F.col("b").alias("node")), ["chain_id", "node"], "left_semi").select("chain_id").distinct())
        found, seen = found.union(hit), stash(seen.union(new))
        frontier = new.join(hit, "chain_id", "left_anti")


def _shortcuts(edges: DataFrame) -> DataFrame:
    """Edges with those of two steps, and again, up to SHORTCUTS times as many or FEW; what reaches what stays."""
    most = max(SHORTCUTS * edges.count(), FEW)
    while True:
        degree = lambda c: edges.groupBy(F.col(c).alias("node")).agg(F.count("*").alias(f"n_{c}"))
        more = degree("a").join(degree("b"), "node").agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0] or 0
        have = edges.count()
        if not more or have + more > most:
            return edges
        two = edges.select("a", F.col("b").alias("m")).join(edges.select(F.col("a").alias("m"), "b"), "m").select("a", "b").where("a <> b")
        edges = stash(edges.union(two).distinct())
        if edges.count() == have:
            return edges


def connected(edges: DataFrame, pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(chain_id) of pairs(chain_id, a, b) where b is a or reached from it over edges(a, b).

    What a well-linked node (the pivot) reaches and what reaches it settles most pairs at once: those from the one side to the other
    are connected, and others can't be. Pairs that stay open start beside the one side, or end beside the other, and so do their
    paths; they are searched one by one while that takes fewer rows than the graph has edges, else from the next pivot.
    """
    edges = _shortcuts(stash(edges.select("a", "b").where("a <> b").distinct()))
    pairs = stash(pairs.select("chain_id", "a", "b").distinct())
    most, found = edges.count(), pairs.where("a = b").select("chain_id").distinct()
    pairs = pairs.join(found, "chain_id", "left_anti")
    degree = lambda c: edges.groupBy(F.col(c).alias("node")).agg(F.count("*").alias(f"n_{c}"))
    pivot = stash(degree("a").join(degree("b"), "node").orderBy(F.least("n_a", "n_b").desc(), "node").limit(1).select("node"))
    ahead, behind = _closure(edges, pivot, "a", "b"), _closure(edges, pivot, "b", "a")
    for nodes, side in ((ahead, "ahead"), (behind, "behind")):
        for end in "ab":
            pairs = pairs.join(nodes.select(F.col("node").alias(end), F.lit(True).alias(f"{end}_{side}")), end, "left")
    pairs = stash(pairs.na.fill(False))
    found = stash(found.union(pairs.where("a_behind AND b_ahead").select("chain_id")).distinct())
    never = "(a_ahead AND NOT b_ahead) OR (b_behind AND NOT a_behind)"
    open_ = stash(pairs.where(f"NOT ({never})").join(found, "chain_id", "left_anti"))
    for which, avoid in (("a_behind", ahead), ("NOT a_behind", behind)):
        some = open_.where(which).select("chain_id", "a", "b")
        if some.isEmpty():
            continue
        left = edges
        for end in "ab":
            left = left.join(avoid.select(F.col("node").alias(end)), end, "left_anti")
        left = stash(left.select("a", "b"))
        rest = _search(left, some, most if rounds > 1 and not pivot.isEmpty() else None)
        found = found.union(connected(left, some, rounds - 1) if rest is None else rest)
    return found.distinct()


def chains(graph: Graph, specs: DataFrame) -> DataFrame:
    """(chain_id, ok) for all chains at once. specs: chain_id, repo_id, start_name, start_path, end_name, end_path."""
    specs = stash(specs)
    located = graph.symbols.select("symbol_id", "name", "file_id").join(graph.files.select("file_id", "repo_id", "path"), "file_id")
    begin = specs.join(located, (specs["start_name"] == located["name"]) & (specs["start_path"] == located["path"]) & (specs["repo_id"] == located["repo_id"])).select("chain_id", F.col("symbol_id").alias("a"))
    ends = specs.join(located, (specs["end_name"] == located["name"]) & (specs["end_path"] == located["path"])).select("chain_id", F.col("symbol_id").alias("b"))
    hit = connected(_ends(graph.edges, ["call"], True), begin.join(ends, "chain_id")).withColumn("ok", F.lit(True))
    return specs.select("chain_id").join(hit, "chain_id", "left").select("chain_id", F.coalesce("ok", F.lit(False)).alias("ok"))


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes below roots(node_id) with their level, the roots at 0."""
    edges = nodes.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("a"), F.col("node_id").alias("b"))
    found = hops(edges, roots.select(F.col("node_id").alias("start"), F.col("node_id").alias("node")), 0, seed=True)
    return found.join(nodes.withColumnRenamed("node_id", "node"), "node").select("start", F.col("node").alias("node_id"), "type", "start_line", F.col("depth").alias("level"))


def expand(graph: Graph, hits: DataFrame, top: int = 5) -> DataFrame:
    """hits(hit_id, symbol_id) with their first `top` callers and callees by name, in one join a direction."""
    s = graph.symbols.select(F.col("symbol_id").alias("other"), "name", "kind")
    order = Window.partitionBy("hit_id", "symbol_id").orderBy("name", "other")
    out = None
    for side, forward in (("callers", False), ("callees", True)):
        e = _ends(graph.edges, ["call"], forward)
        near = hits.join(e, F.col("symbol_id") == F.col("a")).select("hit_id", "symbol_id", F.col("b").alias("other")).join(s, "other")
        near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top)
        part = near.select("hit_id", "symbol_id", F.lit(side).alias("side"), F.col("n").alias("position"), F.col("other").alias("neighbour_id"), "name", "kind")
        out = part if out is None else out.union(part)
    return out


def topological(nodes: DataFrame) -> DataFrame:
    """Nodes with a depth that puts parents before children; nodes on a cycle come last, without one."""
    found = subtree(nodes, nodes.where("parent_id IS NULL").select("node_id")).select("node_id", F.col("level").alias("depth"))
    return nodes.join(found, "node_id", "left")
