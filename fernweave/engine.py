"""One object with the catalogue's calls, over a versioned store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.operators import metrics, reach, relations, retrieval, scans
from fernweave.operators.chunking import hashing_embedder
from fernweave.operators.mutations import Store
from fernweave.plans import indexing
from fernweave.plans.schema import SCHEMAS


class Engine:
    def __init__(self, spark: SparkSession, root: str, options: indexing.Options = indexing.Options()):
        self.spark, self.store, self.options = spark, Store(spark, root), options

    @property
    def graph(self):
        return self.store.graph()

    def health(self) -> dict[str, bool]:
        return {name: self.store.exists(name) for name in SCHEMAS}

    def index(self, root: str, repo_id: str, name: str, options: indexing.Options | None = None) -> indexing.Result:
        return indexing.index(self.spark, self.store, root, repo_id, name, options or self.options)

    def repositories(self) -> DataFrame:
        return scans.all_repos(self.store.read("repositories"))

    def repository(self, repo_id: str) -> DataFrame:
        return scans.repo_by_id(self.store.read("repositories"), repo_id)

    def file_symbols(self, file_id: str) -> DataFrame:
        return scans.symbols_by_file(self.store.read("symbols"), file_id)

    def callers(self, symbol_id: str) -> DataFrame:
        return relations.callers(self.graph, symbol_id)

    def callees(self, symbol_id: str) -> DataFrame:
        return relations.callees(self.graph, symbol_id)

    def dependencies(self, symbol_id: str) -> DataFrame:
        return relations.dependencies(self.graph, symbol_id)

    def transitive_callers(self, symbol_id: str, depth: int | None = None) -> DataFrame:
        return self._reach(symbol_id, depth, False)

    def transitive_callees(self, symbol_id: str, depth: int | None = None) -> DataFrame:
        return self._reach(symbol_id, depth, True)

    def _reach(self, symbol_id: str, depth: int | None, forward: bool) -> DataFrame:
        start = self.spark.createDataFrame([(symbol_id,)], "symbol_id string")
        return reach.reachable(self.graph, start, depth, forward).orderBy("depth", "name")

    def impact(self, symbol_id: str, depth: int | None = None) -> str:
        return reach.render_impact(reach.impact_tree(self.transitive_callers(symbol_id, depth)).collect())

    def questions(self, texts: list[str]) -> DataFrame:
        vectors = hashing_embedder(self.options.dimension)(texts)
        return self.spark.createDataFrame([(i, t, [float(x) for x in v]) for i, (t, v) in enumerate(zip(texts, vectors))], "query_id int, text string, embedding array<float>")

    def search(self, texts: list[str], mode: str = "hybrid", limit: int = 10, filters: retrieval.Filters = retrieval.Filters()) -> DataFrame:
        return retrieval.search(self.graph, self.questions(texts), mode or "hybrid", limit or 10, filters)

    def ask(self, texts: list[str], config: retrieval.Config = retrieval.Config()) -> DataFrame:
        if not any(t.strip() for t in texts):
            raise ValueError("a question is needed")
        return retrieval.ask(self.graph, self.questions(texts), config)

    def chunks(self, vector_ids: list[str]) -> DataFrame:
        return retrieval.chunks(self.graph, vector_ids)

    def stats(self) -> DataFrame:
        return metrics.counts(self.graph)

    def evaluate(self, repo_id: str, override: dict[str, float] | None = None) -> DataFrame:
        return metrics.passed(metrics.graph_metrics(self.graph, repo_id), override=override)

    def report(self, repo_id: str) -> list[str]:
        """Metrics with their gates as JSON lines."""
        return self.evaluate(repo_id).select(F.to_json(F.struct("metric", "value", "threshold", "passed")).alias("j")).toPandas()["j"].tolist()
