"""Exact top-k by Hamming distance with incremental multi-index hashing.

A 64-bit code is cut into SEGMENTS parts of 16 bits, each with an index of its own. The search radius of the segments grows
from 0: at radius r all values of a segment that differ from the query's in r bits are looked up, and the codes found are
verified by their whole distance. All codes within SEGMENTS * (r + 1) - 1 are then known, so a query is done when its k-th
verified distance is no larger, and before that it grows only the segments that its k-th distance asks for. A code is emitted only at the smallest (segment distance, segment) that it has, hence once.

Equal codes are one entry with its k smallest ids, which is all that a top-k with ties by id can need. Rows whose vector or id
is null have no code and are neither found nor asked for; null, NaN and missing components count as bit 0. Repeated rows (an
equal id and code) are one. An empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.llm.common import stash, unstash

SEGMENTS, BITS = 4, 16


def sign_code(vector: Column) -> Column:
    """Bit i is 1 where component i is above 0. A code has 64 bits; a longer vector is an error."""
    whole = F.when(F.size(vector) > 64, F.raise_error(F.lit("a code has 64 bits at most")).cast("array<double>")).otherwise(vector.cast("array<double>"))
    bits = F.transform(whole, lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.coalesce(b, F.lit(0).cast("long"))))


def segment(code: Column, k: int) -> Column:
    return F.shiftrightunsigned(code, k * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def segments(code: Column) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("seg"), segment(code, k).alias("value")) for k in range(SEGMENTS)))


def top_k(queries: DataFrame, codes: DataFrame, k: int = 10) -> DataFrame:
    """queries (qid, code) against codes (id, code): qid, rank, id, distance of the k nearest, ties by id."""
    known = codes.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct()
    by_id = Window.partitionBy("code").orderBy("id")
    entries = stash(known.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    index = stash(entries.select("code", "ids", F.explode(segments(F.col("code"))).alias("s")).select("code", "ids", "s.seg", "s.value"))
    asked = stash(queries.where("qid IS NOT NULL AND code IS NOT NULL").select("qid", F.col("code").alias("q")).distinct())
    found, active = None, asked.withColumns({"top": F.lit(SEGMENTS - 1), "most": F.lit(64)})
    nearest = Window.partitionBy("qid").orderBy("distance", "id")
    for r in range(BITS + 1):
        masks = F.from_json(F.lit(json.dumps([m for m in range(1 << BITS) if m.bit_count() == r])), "array<int>")
        # a query that has k codes needs only the segments in which a code at its k-th distance can come up first
        probes = active.repartition("qid").select("qid", "q", "top", "most", F.explode(segments(F.col("q"))).alias("s")).where("s.seg <= top")
        probes = probes.select("qid", "q", "most", "s.seg", "s.value", F.explode(masks).alias("mask"))
        probes = probes.select("qid", "q", "most", "seg", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        apart = F.col("q").bitwiseXOR(F.col("code"))
        first = F.bit_count(apart) <= F.col("most")  # beyond the k-th verified distance a code cannot count
        for s in range(SEGMENTS):
            d = F.bit_count(segment(apart, s))
            first = first & F.when(F.lit(s) < F.col("seg"), d > r).when(F.lit(s) > F.col("seg"), d >= r).otherwise(F.lit(True))
        hits = probes.hint("merge").join(index, ["seg", "value"]).where(first).select("qid", "ids", F.bit_count(apart).alias("distance"))
        hits = hits.select("qid", F.explode("ids").alias("id"), "distance")
        every = hits if found is None else hits.union(found)
        best = stash(every.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("qid", "id", "distance"))
        if found is not None:
            unstash(found)
        found = best
        reached = found.groupBy("qid").agg(F.count("*").alias("n"), F.max("distance").alias("kth"))
        top = F.when(F.col("n") == k, F.least(F.col("kth") - SEGMENTS * (r + 1), F.lit(SEGMENTS - 1))).otherwise(SEGMENTS - 1)
        left = stash(asked.join(reached, "qid", "left").select("qid", "q", top.alias("top"), F.when(F.col("n") == k, F.col("kth")).otherwise(64).alias("most")).where("top >= 0"))
        unstash(active)
        active = left
        if active.isEmpty():
            break
    return found.withColumn("rank", F.row_number().over(nearest)).select("qid", "rank", "id", "distance")
