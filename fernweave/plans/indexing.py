"""Indexing a source tree: scan, parse, collect, resolve, validate, upsert, chunk, embed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.functions.lineage import stash, unstash
from fernweave.functions.text import file_symbol_id
from fernweave.operators import chunking, mutations, relations, resolution, validation
from fernweave.operators.mutations import Store
from fernweave.plans.schema import SCHEMAS
from fernweave.sources import parsers, scan

#: Errors and violations that a result names; all are counted.
SHOWN = 1000


@dataclass(frozen=True)
class Options:
    incremental: bool = True
    delete_missing: bool = False
    associate_headers: bool = True
    embed: bool = True
    model: str = "hashing-64"
    dimension: int = 64
    languages: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Result:
    status: str
    files: int
    symbols: int
    edges: int
    vectors: int
    errors: list[tuple[str, str]]  # the first SHOWN of them
    n_errors: int = 0


def _shaped(df: DataFrame, name: str) -> DataFrame:
    """The columns of a stored table, in order; missing ones are null."""
    schema = df.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    return df.select(*((F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def changed(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files of which the store does not have both the id and the checksum."""
    return files.join(stored.select("file_id", "checksum"), ["file_id", "checksum"], "left_anti")


def extract(sources: DataFrame) -> dict[str, DataFrame]:
    """files, symbols, dependencies, errors of scanned sources."""
    parsed = stash(parsers.parse(sources).join(sources.select("path", "file_id", "size", "checksum"), "path"))
    symbols = parsed.select("file_id", "path", F.posexplode("symbols").alias("ordinal", "s")).select("file_id", "path", "ordinal", "s.*")
    deps = parsed.select("file_id", "path", F.posexplode("dependencies").alias("n", "d")).select("file_id", "path", "n", "d.*")
    deps = deps.withColumn("dep_id", F.concat_ws(":", "path", F.lpad(F.col("n").cast("string"), 8, "0")))
    return {
        "files": parsed.select("file_id", "path", F.lower("language").alias("language"), "size", "checksum"),
        "symbols": resolution.collect_symbols(symbols), "dependencies": deps,
        "errors": parsed.where("error IS NOT NULL").select(F.col("path").alias("file"), F.col("error").alias("message"), F.lit("parse").alias("type")),
    }


def edges_of(found: dict[str, DataFrame], known: DataFrame) -> DataFrame:
    """Resolved edges. Imports of files without a symbol of their own start at the file's virtual symbol."""
    deps = found["dependencies"]
    imports = deps.where("type = 'import'").select("file_id", F.col("target_module").alias("module"))
    edges = resolution.resolve(deps, known, imports, resolution.external_symbols(deps))
    virtual = F.when(F.col("edge_type") == "import", file_symbol_id(F.col("source_file")))
    return edges.withColumn("source_id", F.coalesce("source_id", virtual))


def _external_file(external: DataFrame) -> DataFrame:
    """The row of the file that external symbols belong to, if there are any."""
    row = external.select(F.col("file_path").alias("file_id"), F.col("file_path").alias("path")).distinct()
    return _shaped(row.withColumns({"repo_id": F.lit(None), "language": F.lit("external"), "size": F.lit(0), "checksum": F.lit("")}), "files")


def violations(files: DataFrame, symbols: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    return validation.files(files).union(validation.symbols(symbols, files)).union(validation.edges(edges, known))


def index(spark: SparkSession, store: Store, root: str, repo_id: str, name: str, options: Options = Options()) -> Result:
    """Index the tree below root as a repository. Violations stop it before anything is written, with status failed."""
    sources = scan.scan_gitignored(spark, root, languages=list(options.languages) or None, patterns=list(options.patterns))
    stored = store.read("files").where(F.col("repo_id") == repo_id)
    sources = stash(sources)
    fresh = changed(sources, stored) if options.incremental else sources
    found = extract(fresh)
    files = stash(found["files"])
    symbols = stash(found["symbols"])
    virtual = relations.virtual_file_symbols(files).withColumns({"start_line": F.lit(1), "end_line": F.lit(1), "start_byte": F.lit(0), "end_byte": F.lit(0)})
    external = resolution.external_symbols(found["dependencies"])
    own = _shaped(symbols, "symbols").union(_shaped(virtual, "symbols"))
    # names of files that stay as they are can be meant too
    paths = store.read("files").join(files.select("path"), "path", "left_anti")
    kept = store.read("symbols").join(paths.select("file_id", "path"), "file_id").where("kind <> 'external'").select("symbol_id", "name", "path")
    known = symbols.select("symbol_id", "name", "path").union(kept)
    edges = stash(edges_of(found, known))
    ids = own.select("symbol_id").union(kept.select("symbol_id")).union(external.select("symbol_id")).union(virtual.select("symbol_id")).union(store.read("symbols").select("symbol_id"))
    n_errors = found["errors"].count()
    errors = [(r["file"], r["message"]) for r in found["errors"].limit(SHOWN).collect()]
    wrong = stash(violations(files, _shaped(symbols, "symbols"), edges, ids))
    if n_wrong := wrong.count():
        return Result("failed", 0, 0, 0, 0, [(r["entity_id"], r["message"]) for r in wrong.limit(SHOWN).collect()], n_wrong)
    unstash(wrong)
    repo = spark.createDataFrame([(repo_id, name, root, "main")], "repo_id string, name string, url string, branch string")
    graph = store.graph()
    incoming = _shaped(files.withColumn("repo_id", F.lit(repo_id)), "files")
    left = mutations.replace_files(graph, incoming)
    if options.delete_missing:
        gone = stored.join(sources.select("path"), "path", "left_anti")
        left = mutations.delete_files(left, gone)
    new_edges = _shaped(edges, "edges")
    if options.associate_headers:
        new_edges = new_edges.union(_shaped(header_edges(files.withColumn("repo_id", F.lit(repo_id)), symbols), "edges"))
    tables = {
        "repositories": store.upserted("repositories", _shaped(repo, "repositories")),
        "symbols": mutations.upsert(left.symbols, own.union(_shaped(external.withColumn("file_id", F.col("file_path")), "symbols")), ["symbol_id"]),
        "edges": mutations.upsert(left.edges, new_edges, ["edge_id"], keep=mutations.KEPT["edges"]),
        "files": mutations.upsert(left.files, _external_file(external), ["file_id"]),
        "ast_nodes": left.nodes,
    }
    n = 0
    if options.embed:
        chunks = chunking.symbol_chunks(_shaped(symbols, "symbols"))
        vectors = stash(chunking.embed(chunks, chunking.hashing_embedder(options.dimension), options.model, options.dimension))
        tables["vectors"] = store.upserted("vectors", _shaped(vectors.where("error IS NULL"), "vectors"))
        n = vectors.count()
    store.write_all(tables)
    if options.embed:
        unstash(vectors)
    result = Result("success_with_warnings" if errors else "success", files.count(), symbols.count(), edges.count(), n, errors, n_errors)
    unstash(sources, files, symbols, edges)
    return result


def header_edges(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """File-level and symbol-level edges from implementations to the headers that declare them."""
    from fernweave.functions.text import edge_id

    pairs = relations.header_pairs(files)
    top = pairs.select(
        file_symbol_id(F.col("impl_path")).alias("source_id"), file_symbol_id(F.col("header_path")).alias("target_id"), F.lit("implements_header").alias("edge_type"),
        F.col("impl_path").alias("source_file"), F.col("header_path").alias("target_file"),
    )
    matched = relations.declaration_matches(pairs, symbols).join(pairs, ["header_id", "impl_id"]).select(
        F.col("implementation_id").alias("source_id"), F.col("declaration_id").alias("target_id"), F.lit("implements_declaration").alias("edge_type"), F.col("impl_path").alias("source_file"), F.col("header_path").alias("target_file")
    )
    both = top.union(matched)
    return both.withColumn("edge_id", edge_id(F.col("source_id"), F.col("edge_type"), F.col("target_id"), F.col("target_id"), F.col("source_file")))
