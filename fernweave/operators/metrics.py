"""Counts and quality metrics over the graph and over retrieval results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernweave.operators.relations import left_on_target
from fernweave.plans.schema import Graph


@dataclass(frozen=True)
class Gate:
    """A threshold of 0 only observes."""

    threshold: float
    at_most: bool = False


#: The gates of the quality report.
GATES = {
    "dangling_edge_ratio_call": Gate(0.90, True),
    "dangling_edge_ratio_reference": Gate(0.80, True),
    "symbol_resolution_rate_call": Gate(0.10),
    "orphan_symbol_ratio": Gate(0.40, True),
    "cross_file_connectivity": Gate(0.10),
    "edge_recall": Gate(0.90),
    "edge_precision": Gate(0.85),
    "call_chain_connectivity": Gate(0.95),
}


def counts(graph: Graph) -> DataFrame:
    """Rows of each table, in one job."""
    parts = {"repositories": graph.repos, "files": graph.files, "symbols": graph.symbols, "edges": graph.edges, "ast_nodes": graph.nodes, "vectors": graph.vectors}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.union(one)
    return out


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def edge_counts(graph: Graph) -> DataFrame:
    """By repository and type: all edges, dangling ones and ones between files, in one pass."""
    owner = graph.symbols.select("symbol_id", "file_id").join(graph.files.select("file_id", "repo_id"), "file_id")
    s = owner.select(F.col("symbol_id").alias("source_id"), "repo_id", F.col("file_id").alias("source_file"))
    t = graph.symbols.select(F.col("symbol_id").alias("__t"), F.col("file_id").alias("target_file"))
    joined = left_on_target(graph.edges.select("source_id", "target_id", "edge_type").join(s, "source_id"), t, "__t")
    return joined.groupBy("repo_id", "edge_type").agg(
        F.count("*").alias("edges"), F.count_if(F.col("target_id").isNull()).alias("dangling"), F.count_if(F.col("source_file") != F.col("target_file")).alias("cross_file")
    )


def orphan_symbols(graph: Graph, repo_id: object = None) -> DataFrame:
    """Symbols that no edge leaves or reaches."""
    symbols = graph.symbols
    if repo_id is not None:
        symbols = symbols.join(graph.files.where(F.col("repo_id") == repo_id).select("file_id"), "file_id", "left_semi")
    out = symbols.join(graph.edges.select(F.col("source_id").alias("symbol_id")), "symbol_id", "left_anti")
    return out.join(graph.edges.where("target_id IS NOT NULL").select(F.col("target_id").alias("symbol_id")), "symbol_id", "left_anti")


def graph_metrics(graph: Graph, repo_id: object) -> DataFrame:
    """(metric, value) of one repository; a ratio is there only if its denominator is above 0."""
    c = edge_counts(graph).where(F.col("repo_id") == repo_id)
    total = c.agg(F.sum("edges").alias("e"), F.sum("dangling").alias("d"), F.sum("cross_file").alias("x"))
    ratio = lambda name, n, d: F.struct(F.lit(name).alias("metric"), (F.col(n).cast("double") / F.col(d)).alias("value"))
    rows = total.where("e > 0").select(F.explode(F.array(
        ratio("dangling_edge_ratio", "d", "e"), F.struct(F.lit("symbol_resolution_rate").alias("metric"), (1 - F.col("d").cast("double") / F.col("e")).alias("value")), ratio("cross_file_connectivity", "x", "e"),
    )).alias("m")).select("m.metric", "m.value")
    rows = rows.union(c.select(F.concat(F.lit("dangling_edge_ratio_"), "edge_type"), F.col("dangling").cast("double") / F.col("edges")))
    rows = rows.union(c.where("edge_type = 'call'").select(F.lit("symbol_resolution_rate_call"), 1 - F.col("dangling").cast("double") / F.col("edges")))
    share = c.crossJoin(F.broadcast(total.where("e > 0"))).select(F.concat(F.lit("edge_type_distribution_"), "edge_type"), F.col("edges").cast("double") / F.col("e"))  # a one-row total
    mine = graph.symbols.join(graph.files.where(F.col("repo_id") == repo_id).select("file_id"), "file_id", "left_semi")
    linked = graph.edges.select(F.col("source_id").alias("symbol_id")).union(graph.edges.where("target_id IS NOT NULL").select("target_id")).distinct().withColumn("linked", F.lit(1))
    orphans = mine.join(linked, "symbol_id", "left").agg(F.count("*").alias("n"), F.count_if(F.col("linked").isNull()).alias("o")).where("n > 0")
    return rows.union(share).union(orphans.select(F.lit("orphan_symbol_ratio"), F.col("o").cast("double") / F.col("n")))


def edge_match(extracted: DataFrame, truth: DataFrame) -> DataFrame:
    """edge_recall and edge_precision. extracted: source_name, edge_type, target_name, target_id; truth: source_name, edge_type,
    target_name, optional. Rows count, not distinct edges."""
    keys = ["source_name", "edge_type", "target_name"]
    real = extracted.where("target_id IS NOT NULL AND cast(target_id AS string) <> ''")
    wanted = truth.where("NOT optional AND target_name <> ''")
    hit = wanted.join(real.select(*keys).distinct().withColumn("hit", F.lit(1)), keys, "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("value"))
    known = truth.where("target_name <> ''").select(*keys).distinct().withColumn("hit", F.lit(1))
    right = real.join(known, keys, "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("value"))
    return hit.select(F.lit("edge_recall").alias("metric"), "value").union(right.select(F.lit("edge_precision"), "value"))


def _first(results: DataFrame, k: int) -> DataFrame:
    return results.where(F.col("rank") <= k).groupBy("mode", "query_id", "name").agg(F.min("rank").alias("rank"))


def _retrieval(results: DataFrame, hits: DataFrame, size: DataFrame) -> DataFrame:
    hits = hits.groupBy("mode", "query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    asked = results.select("mode", "query_id").distinct().join(size, "query_id")
    return asked.join(hits, ["mode", "query_id"], "left").select(
        "mode", "query_id", (F.coalesce("hits", F.lit(0)).cast("double") / F.col("wanted")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr")
    )


def retrieval_metrics(results: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(mode, query_id, recall, mrr). results: mode, query_id, rank, name; relevant: query_id, name. Names count once."""
    size = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("wanted"))
    return _retrieval(results, _first(results, k).join(relevant.distinct(), ["query_id", "name"]), size)


def labelled_metrics(results: DataFrame, questions: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """retrieval_metrics where the names of a question's label are relevant, without a row for each question and such name.

    questions: query_id, label; items: name, label; one label each.
    """
    questions, items = questions.select("query_id", "label").distinct(), items.select("name", "label").distinct()
    size = questions.join(items.groupBy("label").agg(F.count("*").alias("wanted")), "label").select("query_id", "wanted")
    return _retrieval(results, _first(results, k).join(questions, "query_id").join(items, ["name", "label"]), size)


def neighbor_hits(neighbours: DataFrame, relevant: DataFrame) -> DataFrame:
    """Share of the queries with neighbours (query_id, name) of which one at least is relevant."""
    hit = neighbours.join(relevant.distinct(), ["query_id", "name"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    return neighbours.select("query_id").distinct().join(hit, "query_id", "left").agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0)).alias("value"))


def mode_compare(per_query: DataFrame) -> DataFrame:
    """Differences of the modes' mean recall."""
    means = per_query.groupBy("mode").agg(F.avg("recall").alias("recall"))
    a, b = means.select(F.col("mode").alias("mode_a"), F.col("recall").alias("ra")), means.select(F.col("mode").alias("mode_b"), F.col("recall").alias("rb"))
    return a.join(b, F.col("mode_a") < F.col("mode_b")).select("mode_a", "mode_b", (F.col("ra") - F.col("rb")).alias("difference"))  # a row for each mode


def passed(metrics: DataFrame, gates: dict[str, Gate] | None = None, override: dict[str, float] | None = None) -> DataFrame:
    """metric, value, threshold, passed; metrics that are only observed pass."""
    ok, bound = F.lit(True), F.lit(0.0)
    for name, gate in (gates or GATES).items():
        limit = (override or {}).get(name, gate.threshold)
        bound = F.when(F.col("metric") == name, F.lit(float(limit))).otherwise(bound)
        if limit:
            ok = F.when(F.col("metric") == name, F.col("value") <= limit if gate.at_most else F.col("value") >= limit).otherwise(ok)
    return metrics.select("metric", "value", bound.alias("threshold"), ok.alias("passed"))


def summary(gated: DataFrame) -> DataFrame:
    return gated.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def truth_ids(truth: DataFrame, graph: Graph) -> DataFrame:
    """truth(query_id, name, files array) with the symbol of that name: one in the files first, then the smallest id.

    Two lookups of one row each, so a name that many symbols share makes no product.
    """
    s = graph.symbols.select("symbol_id", "name", "file_id").join(graph.files.select("file_id", "path"), "file_id", "left")
    near = s.where("path IS NOT NULL").groupBy("name", "path").agg(F.min("symbol_id").alias("near"))
    near = truth.select("query_id", "name", F.explode("files").alias("path")).distinct().join(near, ["name", "path"]).groupBy("query_id", "name").agg(F.min("near").alias("near"))
    far = graph.symbols.groupBy("name").agg(F.min("symbol_id").alias("far"))
    both = truth.select("query_id", "name").distinct().join(far, "name")
    key = F.struct("query_id", "name")  # a null query_id is a question like any other
    both = both.withColumn("__k", key).join(near.select(key.alias("__k"), "near"), "__k", "left")
    return both.select("query_id", "name", F.coalesce("near", "far").alias("symbol_id"))


def errors_by_type(errors: DataFrame) -> DataFrame:
    return count_by(errors, "type")
