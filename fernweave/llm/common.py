"""What the operators share: stashed tables, safe columns and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.functions.lineage import shared_dir, stash, unstash

__all__ = ["components", "shared_dir", "small_enough", "stash", "table", "text_of", "unstash"]

#: Keys of at most this many rows are broadcast; beyond it the join is by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch: texts reach Python a few megabytes at a time, however long they are.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a stashed table of a few columns, if it has at most so many rows; else the table as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column with null as the empty text, for functions that take it in batches of bounded size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return F.coalesce(df[name].cast("string"), F.lit(""))


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of links(a long, b long): rows (node, component), component the smallest reachable node.

    Alternating large-star and small-star steps; each is one shuffle by node with a combining minimum first, and every
    round is stashed, so no link or component is gathered on the driver. Nodes without a link to another are left out.
    """
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def star(e: DataFrame) -> DataFrame:
        # large star: every larger neighbour of u links to the smallest of u's neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    def small(e: DataFrame) -> DataFrame:
        # small star: every smaller neighbour of u, and u, link to the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        return moved.union(low.select("u", F.col("m").alias("v"))).distinct()

    for _ in range(max_rounds):
        after = stash(small(star(edges)))
        total = "count(*) AS n", "coalesce(sum(xxhash64(u, v) >> 20), 0) AS s"
        same = after.selectExpr(*total).first() == edges.selectExpr(*total).first()
        unstash(edges)
        edges = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
