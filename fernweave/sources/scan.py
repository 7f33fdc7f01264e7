"""Directory scans as a Spark source: paths, languages, sizes, checksums and contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.functions.text import checksum, file_id
from fernweave.sources.ignore import ignored, rules
from fernweave.sources.languages import UNKNOWN, is_binary, language

MAX_BYTES = 1024 * 1024
#: Folders that the older repository scan leaves out.
LEGACY_SKIPPED = ["node_modules", "vendor", "target"]
PARSED = ["Go", "JavaScript", "TypeScript", "Python", "Java", "Kotlin", "Swift", "Objective-C", "C", "C++"]


def _files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/")
    df = reader.load(root)
    # the path below the root, whatever scheme the file system puts in front
    below = F.regexp_replace(F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:/+", "/"), "^/*" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base.split("://")[-1].lstrip("/")) + "/*", "")
    return df.select(below.alias("path"), F.col("length").alias("size"), "content")


def scan(spark: SparkSession, root: str, languages: list[str] | None = None, patterns: list[str] | None = None, defaults: bool = True, max_bytes: int = MAX_BYTES, glob: str | None = None) -> DataFrame:
    """path, language, size, checksum, file_id, content of the files below root that no rule excludes. Files of unknown
    language are left out unless languages are asked for."""
    df = _files(spark, root, glob)
    df = df.where(~ignored(F.col("path"), rules(patterns or [], defaults))).where(~is_binary(F.col("path"))).where(F.col("size") <= max_bytes)
    df = df.withColumn("language", language(F.col("path"), F.col("content")))
    if languages:
        df = df.where(F.lower("language").isin([x.lower() for x in languages]))
    else:
        df = df.where(F.col("language") != UNKNOWN)
    return df.withColumn("checksum", checksum(F.col("content"))).withColumn("file_id", file_id(F.col("path"), F.col("checksum")))


def scan_gitignored(spark: SparkSession, root: str, **options) -> DataFrame:
    """A scan with the root's own .gitignore lines before the given patterns."""
    # Spark's readers pass over hidden files, so this one is read through the file system
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    lines: list[str] = []
    if fs.exists(path):
        stream = fs.open(path)
        lines = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
        stream.close()
    return scan(spark, root, patterns=lines + (options.pop("patterns", None) or []), **options)


def scan_file(spark: SparkSession, path: str, languages: list[str] | None = None) -> DataFrame:
    """One file of a language that is parsed; the language filter minds letter case here."""
    df = _files(spark, path.rsplit("/", 1)[0], path.rsplit("/", 1)[-1]).withColumn("language", language(F.col("path"), F.col("content")))
    df = df.where(F.col("language").isin(PARSED))
    if languages:
        df = df.where(F.col("language").isin(languages))
    return df.withColumn("checksum", checksum(F.col("content"))).withColumn("file_id", file_id(F.col("path"), F.col("checksum")))


def scan_repository(spark: SparkSession, root: str) -> DataFrame:
    """The older scan: no hidden files or folders, none of the skipped folders, unknown languages kept."""
    df = _files(spark, root)
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(LEGACY_SKIPPED))
    df = df.where(~hidden).where(~is_binary(F.col("path"))).where(F.col("size") <= MAX_BYTES)
    return df.withColumn("language", language(F.col("path"), F.col("content")))
