"""The driver's tables seen as a code graph, and the same view as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.plans.schema import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    read = lambda name: table(spark, sf_dir, name)
    repos = read("region").select(F.col("r_regionkey").cast("long").alias("repo_id"), F.col("r_name").alias("name"), F.concat(F.lit("https://example.org/"), F.lower("r_name")).alias("url"), F.lit("main").alias("branch"))
    path = F.concat("n_name", F.lit("/"), "c_name")
    files = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("file_id"), F.col("n_regionkey").cast("long").alias("repo_id"), path.alias("path"), F.lower("c_mktsegment").alias("language"),
        F.floor(F.abs("c_acctbal") * 100).cast("long").alias("size"), F.sha2(path, 256).alias("checksum"),
    )
    o = F.col("o_orderkey")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "function").when(F.col("o_orderpriority").startswith("2"), "class").when(F.col("o_orderpriority").startswith("3"), "interface").when(F.col("o_orderpriority").startswith("4"), "variable").otherwise("module")
    name = F.concat(F.lit("sym"), o.cast("string"))
    start = o * 7 % 997 + 1
    symbols = read("orders").select(
        o.alias("symbol_id"), F.col("o_custkey").alias("file_id"), name.alias("name"), kind.alias("kind"), F.concat(kind, F.lit(" "), name).alias("signature"),
        start.alias("start_line"), (start + o % 40).alias("end_line"), (start * 40).alias("start_byte"), (start * 40 + o % 40 * 40 + 20).alias("end_byte"),
        F.when(o % 3 == 0, "").when(o % 3 == 1, None).otherwise(F.concat(F.lit("order with status "), "o_orderstatus")).alias("docstring"),
    )
    # the number of orders is one row, so a join with it is no product of tables
    many = read("orders").agg(F.count("*").alias("many"))
    flags = F.concat("l_returnflag", "l_linestatus")
    edge_type = F.when(flags.isin("NO", "AF"), "call").when(flags == "RF", "import").when(flags == "NF", "extends").when(flags == "AO", "implements").otherwise("reference")
    dangling = F.col("l_linenumber") % 5 == 0
    edges = read("lineitem").join(F.broadcast(many)).select(
        F.col("l_orderkey").alias("source_id"), F.when(~dangling, (F.col("l_partkey") * 37 + F.col("l_suppkey") * 11 + F.col("l_linenumber")) % F.col("many")).alias("target_id"),
        edge_type.alias("edge_type"), F.when(dangling, F.concat(F.lit("mod"), F.col("l_suppkey").cast("string"))).alias("target_module"),
    ).distinct()
    turn = lambda t: F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string"))
    nodes = read("conversations").select(
        turn(F.col("turn")).alias("node_id"), F.col("conv_id").alias("file_id"), F.when(F.col("turn") > 0, turn(F.col("turn") - 1)).alias("parent_id"),
        F.col("role").alias("type"), (F.col("turn") + 1).alias("start_line"), F.col("text"),
    )
    docs = read("documents").select(F.col("doc_id").alias("entity_id"), F.col("text").alias("content"))
    vectors = read("embeddings").select(F.col("vec_id").alias("entity_id"), "embedding", "label").join(docs, "entity_id", "left").select(
        F.col("entity_id").alias("vector_id"), "entity_id", F.lit("symbol").alias("entity_type"), "embedding", F.coalesce("content", F.lit("")).alias("content"), F.lit("synthetic-64").alias("model"), F.lit(0).alias("chunk_index"), "label"
    )
    return Graph(repos, files, symbols, edges, nodes, vectors)


SQL = """
WITH RECURSIVE repos AS (SELECT r_regionkey::BIGINT AS repo_id, r_name AS name, 'https://example.org/' || lower(r_name) AS url, 'main' AS branch FROM region),
files AS (
  SELECT c_custkey AS file_id, n_regionkey::BIGINT AS repo_id, n_name || '/' || c_name AS path, lower(c_mktsegment) AS language,
         floor(abs(c_acctbal) * 100)::BIGINT AS size, sha256(n_name || '/' || c_name) AS checksum
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
symbols0 AS (
  SELECT o_orderkey AS symbol_id, o_custkey AS file_id, 'sym' || o_orderkey AS name,
         CASE o_orderpriority[1] WHEN '1' THEN 'function' WHEN '2' THEN 'class' WHEN '3' THEN 'interface' WHEN '4' THEN 'variable' ELSE 'module' END AS kind,
         o_orderkey * 7 % 997 + 1 AS start_line, o_orderkey, o_orderstatus
  FROM orders
),
symbols AS (
  SELECT symbol_id, file_id, name, kind, kind || ' ' || name AS signature, start_line, start_line + o_orderkey % 40 AS end_line,
         start_line * 40 AS start_byte, start_line * 40 + o_orderkey % 40 * 40 + 20 AS end_byte,
         CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN NULL ELSE 'order with status ' || o_orderstatus END AS docstring
  FROM symbols0
),
edges AS (
  SELECT DISTINCT l_orderkey AS source_id,
         CASE WHEN l_linenumber % 5 <> 0 THEN (l_partkey * 37 + l_suppkey * 11 + l_linenumber) % (SELECT count(*) FROM orders) END AS target_id,
         CASE WHEN l_returnflag || l_linestatus IN ('NO', 'AF') THEN 'call' WHEN l_returnflag || l_linestatus = 'RF' THEN 'import'
              WHEN l_returnflag || l_linestatus = 'NF' THEN 'extends' WHEN l_returnflag || l_linestatus = 'AO' THEN 'implements' ELSE 'reference' END AS edge_type,
         CASE WHEN l_linenumber % 5 = 0 THEN 'mod' || l_suppkey END AS target_module
  FROM lineitem
),
nodes AS (
  SELECT conv_id || '/' || turn AS node_id, conv_id AS file_id, CASE WHEN turn > 0 THEN conv_id || '/' || (turn - 1) END AS parent_id, role AS type, turn + 1 AS start_line, text
  FROM conversations
),
vectors AS (
  SELECT vec_id AS vector_id, vec_id AS entity_id, 'symbol' AS entity_type, embedding, coalesce(text, '') AS content, 'synthetic-64' AS model, 0 AS chunk_index, label
  FROM embeddings LEFT JOIN documents ON doc_id = vec_id
)
"""
