"""Two-pass symbol and edge resolution: names of dependencies to symbol ids, by joins and one ranked window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.functions.text import basename, edge_id, external_id, import_edge_id, symbol_id
from fernweave.plans.schema import EXTERNAL_FILE, SYMBOL_KINDS

#: Raw kinds of the parsers to kinds of symbols (all others: variable), raw dependency types to edge types
#: (all others: reference).
KIND_OF = {
    "function": "function", "method": "function", "class": "class", "struct": "class", "interface": "interface",
    "variable": "variable", "field": "variable", "type": "variable", "package": "package", "module": "module",
}
EDGE_OF = {
    "import": "import", "call": "call", "extends": "extends", "implements": "implements",
    "implements_declaration": "implements_declaration", "calls_declaration": "calls_declaration",
}


def _mapped(c: Column, table: dict[str, str], other: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c], F.lit(other))


def map_kind(raw: Column) -> Column:
    return _mapped(raw, KIND_OF, "variable")


def map_edge(raw: Column) -> Column:
    return _mapped(raw, EDGE_OF, "reference")


def collect_symbols(parsed: DataFrame) -> DataFrame:
    """Pass 1. parsed: file_id, path, ordinal, name, raw_kind, signature, docstring, spans; the first of a file's equal ids counts."""
    ids = parsed.withColumn("symbol_id", symbol_id(F.col("file_id"), F.col("name"), F.col("start_line"), F.col("start_byte")))
    first = Window.partitionBy("file_id", "symbol_id").orderBy("ordinal")
    return ids.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").withColumn("kind", map_kind(F.col("raw_kind")))


def external_symbols(deps: DataFrame) -> DataFrame:
    """A symbol for every external module that is imported."""
    m = deps.where("is_external AND type = 'import' AND coalesce(target_module, '') <> ''").select(F.col("target_module").alias("name")).distinct()
    return m.select(external_id(F.col("name")).alias("symbol_id"), F.lit(EXTERNAL_FILE).alias("file_path"), "name", F.lit(SYMBOL_KINDS[-1]).alias("kind"))


def resolve(deps: DataFrame, symbols: DataFrame, imports: DataFrame, externals: DataFrame | None = None) -> DataFrame:
    """Pass 2: resolved edges, one for each edge id (the first by dep_id).

    deps: dep_id, file_id, path, type, source, target, target_module. symbols: symbol_id, name, path. imports: file_id, module.
    Of several candidates one in the same file comes first, then one whose file the source file imports, then any; ties go to
    the smallest symbol id. Non-import edges without a source are dropped; unresolved targets stay, without an id.
    """
    cand = symbols.select("symbol_id", "name", F.col("path").alias("cpath"), basename(F.col("path")).alias("base"))
    mods = imports.where("coalesce(module, '') <> ''").select("file_id", basename(F.col("module")).alias("base")).distinct()
    # one row for each way to name a symbol, so a name that a third of all files have is joined as one row
    least = F.min(F.struct("symbol_id", "cpath"))
    here = cand.groupBy("name", F.col("cpath").alias("path")).agg(F.min("symbol_id").alias("own"))
    by_base = cand.groupBy("name", "base").agg(least.alias("x"))
    by_name = cand.groupBy("name").agg(least.alias("any"), F.count("*").alias("n"))

    def looked_up(column: str, prefix: str) -> DataFrame:
        asked = deps.select("dep_id", "file_id", "path", F.col(column).alias("name")).where("coalesce(name, '') <> ''")
        found = asked.join(by_name, "name").join(here, ["name", "path"], "left")
        far = found.where("own IS NULL AND n > 0").select("dep_id", "file_id", "name").join(mods, "file_id").join(by_base, ["name", "base"])
        far = far.groupBy("dep_id").agg(F.min("x").alias("imported"))
        found = found.join(far, "dep_id", "left")
        tier = F.when(F.col("own").isNotNull(), 1).when(F.col("imported").isNotNull(), 2).otherwise(3)
        other = F.coalesce("imported", "any")
        return found.select(
            "dep_id", F.coalesce("own", other["symbol_id"]).alias(f"{prefix}_id"), F.when(F.col("own").isNotNull(), F.col("path")).otherwise(other["cpath"]).alias(f"{prefix}_path"),
            tier.alias(f"{prefix}_tier"), F.col("n").alias(f"{prefix}_candidates"),
        )

    d = deps.join(looked_up("source", "source"), "dep_id", "left").join(looked_up("target", "target"), "dep_id", "left")
    if externals is not None:
        e = externals.select(F.col("name").alias("target"), F.col("symbol_id").alias("external"))
        d = d.join(e, "target", "left").withColumn("target_id", F.coalesce("target_id", "external")).drop("external")
    # imports go to a symbol of the module's file, whatever its name
    files = cand.groupBy("base").agg(F.min("symbol_id").alias("module_symbol"))
    d = d.withColumn("base", basename(F.col("target_module"))).join(files, "base", "left")
    is_import = F.col("type") == "import"
    target = F.when(is_import, F.col("module_symbol")).otherwise(F.col("target_id"))
    kind = map_edge(F.col("type"))
    ident = F.when(is_import, import_edge_id(F.col("path"), F.col("type"), F.col("target"), F.col("target_module"))).otherwise(
        edge_id(F.col("source_id").cast("string"), kind, target.cast("string"), F.col("target"), F.col("path"))
    )
    rows = d.where(is_import | F.col("source_id").isNotNull()).select(
        "dep_id", ident.alias("edge_id"), "source_id", target.alias("target_id"), kind.alias("edge_type"), F.col("path").alias("source_file"),
        F.when(~is_import, F.col("target_path")).alias("target_file"), "target_module", "target_candidates",
        F.when(F.col("target_candidates") > 1, F.element_at(F.array(F.lit("same_file"), F.lit("import"), F.lit("first")), F.col("target_tier"))).alias("strategy"),
    )
    first = Window.partitionBy("edge_id").orderBy("dep_id")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def resolve_in_files(deps: DataFrame, symbols: DataFrame) -> DataFrame:
    """The single-file form: both ends must be symbols of the same file."""
    s = symbols.groupBy("path", "name").agg(F.min("symbol_id").alias("id"))
    a, b = s.withColumnsRenamed({"name": "source", "id": "source_id"}), s.withColumnsRenamed({"name": "target", "id": "target_id"})
    return deps.join(a, ["path", "source"]).join(b, ["path", "target"]).select("dep_id", "source_id", "target_id", map_edge(F.col("type")).alias("edge_type"), F.col("path").alias("source_file"))
