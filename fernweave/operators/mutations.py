"""Insert, update, upsert and delete as new versions of a table, and the versioned store that holds them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernweave.operators.relations import left_on_target
from fernweave.plans.schema import KEYS, SCHEMAS, Graph


#: Columns that a stored row keeps when another comes with its key.
KEPT = {"edges": ["source_id"]}


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], keep: list[str] | None = None, only_if: str | None = None, seq: str | None = None) -> DataFrame:
    """Incoming rows replace existing ones of their key. Of incoming rows with one key the last by `seq` counts.

    keep: columns that an existing row retains. only_if: replace only where this column differs.
    """
    new = incoming
    if seq is not None:
        last = Window.partitionBy(*keys).orderBy(F.desc(seq))
        new = new.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", seq)
    else:
        new = new.dropDuplicates(keys)
    columns = existing.columns
    tag = lambda df, side: df.select(*keys, F.struct(*(df[c] for c in columns)).alias(side))
    both = tag(existing, "old").join(tag(new, "new"), keys, "full_outer")
    change = F.col("new").isNotNull() & F.col("old").isNull()
    replace = F.col("new").isNotNull() & F.col("old").isNotNull()
    if only_if:
        replace = replace & ~F.col(f"new.{only_if}").eqNullSafe(F.col(f"old.{only_if}"))
    return both.select(*(F.when(change | (replace & F.lit(c not in (keep or []))), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in columns))


def upsert_files(files: DataFrame, incoming: DataFrame) -> DataFrame:
    """By (repo_id, path), where the checksum differs; a stored file keeps its file_id."""
    return upsert(files, incoming, ["repo_id", "path"], keep=["file_id"], only_if="checksum")


def replace_files(graph: Graph, incoming: DataFrame) -> Graph:
    """Files that come with another checksum replace the stored row of (repo_id, path); its symbols, nodes and edges go."""
    old = graph.files.alias("f").join(incoming.alias("n"), ["repo_id", "path"]).where(~F.col("f.checksum").eqNullSafe(F.col("n.checksum"))).select(F.col("f.file_id").alias("file_id"))
    left = delete_files(graph, old)
    return Graph(left.repos, upsert(left.files, incoming, ["repo_id", "path"]), left.symbols, left.edges, left.nodes, left.vectors)


def update(existing: DataFrame, changes: DataFrame, keys: list[str], nulls: bool = False) -> DataFrame:
    """Set the columns of changes on the rows of its keys. Nulls leave a value as it is, unless `nulls` says that they are set."""
    new = changes.select(*keys, F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in changes.columns if c not in keys))
    joined = existing.join(new, keys, "left")
    value = lambda c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) if nulls else F.coalesce(f"__{c}", c)
    return joined.select(*(value(c).alias(c) if c in changes.columns and c not in keys else F.col(c) for c in existing.columns))


def delete(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_symbols(graph: Graph, gone: DataFrame) -> Graph:
    """Symbols by symbol_id: their outgoing edges go, incoming edges stay and lose their target."""
    ids = gone.select("symbol_id").distinct()
    edges = graph.edges.join(ids.withColumnRenamed("symbol_id", "source_id"), "source_id", "left_anti")
    hit = left_on_target(edges, ids.select(F.col("symbol_id").alias("__t")), "__t")
    edges = hit.withColumn("target_id", F.when(F.col("__t").isNull(), F.col("target_id"))).select(*graph.edges.columns)
    return Graph(graph.repos, graph.files, delete(graph.symbols, ids, ["symbol_id"]), edges, graph.nodes, graph.vectors)


def delete_files(graph: Graph, gone: DataFrame) -> Graph:
    ids = gone.select("file_id").distinct()
    left = delete_symbols(graph, graph.symbols.join(ids, "file_id", "left_semi"))
    return Graph(left.repos, delete(left.files, ids, ["file_id"]), left.symbols, left.edges, delete(left.nodes, ids, ["file_id"]), left.vectors)


class Store:
    """Tables as Parquet versions. What a store holds is named by its last manifest, one small file for all tables, which is written
    aside and renamed; so a write of several tables is seen whole or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _manifest(self) -> tuple[int, dict[str, str]]:
        p, fs = self._fs(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        last = max((n for n in names if n.endswith(".json")), default=None)
        if last is None:
            return 0, {}
        return int(last.removesuffix(".json")), json.loads(self.spark.read.text(f"{self.root}/manifests/{last}", wholetext=True).first()[0])

    def _publish(self, number: int, tables: dict[str, str]) -> bool:
        """Make manifest `number`; False if another writer has made it."""
        aside, fs = self._fs(f"{self.root}/manifests/{uuid.uuid4().hex}.new")
        out = fs.create(aside, False)
        out.write(json.dumps(tables).encode())
        out.close()
        final, _ = self._fs(f"{self.root}/manifests/{number:09d}.json")
        done = not fs.exists(final) and fs.rename(aside, final)
        if not done:
            fs.delete(aside, False)
        return done

    def exists(self, name: str) -> bool:
        return name in self._manifest()[1]

    def read(self, name: str) -> DataFrame:
        version = self._manifest()[1].get(name)
        return self.spark.read.parquet(f"{self.root}/{name}/{version}") if version else self.spark.createDataFrame([], SCHEMAS[name])

    def write_all(self, tables: dict[str, DataFrame]) -> None:
        """New versions of several tables, which become current together."""
        made = {name: uuid.uuid4().hex for name in tables}
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{made[name]}")
        while True:
            number, have = self._manifest()
            if self._publish(number + 1, have | made):
                return

    def write(self, name: str, df: DataFrame) -> None:
        self.write_all({name: df})

    def append(self, name: str, df: DataFrame) -> None:
        self.write(name, self.read(name).unionByName(df, allowMissingColumns=True))

    def upserted(self, name: str, df: DataFrame) -> DataFrame:
        """The table as an upsert of df leaves it."""
        have = self.read(name)
        new = df.select(*(df[c] if c in df.columns else F.lit(None).cast(have.schema[c].dataType).alias(c) for c in have.columns))
        return upsert_files(have, new) if name == "files" else upsert(have, new, KEYS[name], keep=KEPT.get(name))

    def upsert(self, name: str, df: DataFrame) -> None:
        self.write(name, self.upserted(name, df))

    def graph(self) -> Graph:
        return Graph(*(self.read(n) for n in ("repositories", "files", "symbols", "edges", "ast_nodes", "vectors")))
