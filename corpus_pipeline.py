"""The corpus pipeline: quality classifier, line dedup, MinHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents. run() writes each stage's rows as a table in the shared folder and reads them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm import line_dedup, minhash, packing, quality
from fernweave.llm.common import stash, table, unstash
from fernweave.llm.queries import TOKENIZER


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, as they are.

    Null, empty and long texts are scored like others (a null as the empty text) and keep their rows if they are accepted.
    Repeated rows stay or go together. An empty table stays empty; extra columns, whatever their names, are kept.
    """
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return quality.score(rows, net, "row").where("predicted = 1").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand, or nearly stand, earlier; n_chars follows the text.

    Every row stays, some with an empty text. Nulls stay null. Repeated rows keep the same lines. An empty table stays empty; extra
    columns are kept, and n_chars is set only where the table has it and the text has changed.
    """
    out = line_dedup.dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return out.select(*docs.columns)
    n = F.when(F.col("__dropped_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Null and empty texts are one group. A row without doc_id goes by a stand-in from its text. Repeated rows are one document;
    rows of one doc_id with different texts are several. An empty table stays empty; extra columns are kept.
    """
    return minhash.dedup(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences.

    A null or empty text is one piece, the end id alone; long texts are cut into pieces. Repeated rows are packed each by itself. An
    empty table gives no pieces. Of the columns only doc_id and text are read.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("MinHash near-dedup", near_stage), ("best-fit packing", packing_stage)]

#: Classifier, alignment and packing are not expressible in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        after = stash(stage(spark, docs, sf_dir))
        unstash(docs)
        docs = after
    return docs
