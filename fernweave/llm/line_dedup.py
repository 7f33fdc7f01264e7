"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is kept unless the same line, or a line within one edit of a word (a word put in, taken out or replaced), stands earlier in
the collection; the edit must be no more than a fifth of a line, so both lines have MIN_WORDS words or more (shorter ones are
less than 0.8 alike with one edit, and go only if equal). The order is that of (doc_id, text hash, line number), nulls first.
Lines are compared as their words (parts between white space); lines without words are kept.

Equal lines are brought together by hash first, so a line that a third of all rows have is one row from there on. A line that
has a partner within one edit shares its first or its last half with it, for a length they agree on; only lines that share
such a half with another line go on. Of these all variants with one word deleted, and the line itself, are emitted as hashed
keys. Variants with an equal key come of lines within the bound if the same place was deleted in both (a word replaced) or in
one of them nothing was (a word put in); with different places deleted they may be two edits apart. So a variant is held
against the earliest of its key and place and against the earliest whole line of its key, and a whole line against the earliest
of its key, which needs no pairs within a group. The pair's edit distance is verified on the words. Keys are sums of hashes of
(word, place), taken by running sums, so the variants of a line cost its length and not its square.

Null texts stay null and have no lines. Repeated rows (the same doc_id and text) share one place, and each of them keeps what
the first would. An empty table gives an empty table. All columns of the input are returned, whatever
their names; only __dropped_lines is ours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.llm.common import small_enough, stash, unstash

#: One edit leaves lines of so many words 0.8 alike.
MIN_WORDS = 5


def words(line: Column) -> Column:
    # translate goes character by character, so only lines that have one of these pay for it
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c"))
    return F.array_remove(F.split(F.when(odd, F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line), " "), "")


def places(rows: DataFrame) -> DataFrame:
    """Every line with words: __doc, __hash, l (its number), h and g (hashes of its words), n words, keys (hashes of halves)."""
    lines = rows.select("__doc", "__hash", F.posexplode(F.split("__text", "\n")).alias("l", "s"))
    lines = lines.select("__doc", "__hash", "l", words(F.col("s")).alias("w")).where(F.size("w") > 0)
    n = F.size("w")

    def half(c: Column, size: Column, last: bool) -> Column:
        # with one edit, the longer line of c words leaves its first or its last (c - 1) // 2 words to the other
        part = F.slice("w", n - size + 1, size) if last else F.slice("w", 1, size)
        return F.xxhash64(c, F.lit(last), part)

    same, more = ((n - 1) / 2).cast("int"), (n / 2).cast("int")
    keys = F.array(half(n, same, False), half(n, same, True), half(n + 1, more, False), half(n + 1, more, True))
    return lines.select("__doc", "__hash", "l", F.xxhash64("w").alias("h"), F.xxhash64(F.lit("line"), "w").alias("g"), F.when(n >= MIN_WORDS, keys).alias("keys"))


def first_lines(lines: DataFrame) -> DataFrame:
    """Distinct lines: h, g, first (the earliest place), count, keys."""
    place = F.struct(F.col("__doc").alias("d"), F.col("__hash").alias("t"), F.col("l"))
    key = [F.min(F.get("keys", F.lit(i))).alias(f"k{i}") for i in range(4)]  # the same for all places of a line
    return lines.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("places"), *key)


def near_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """h, g of the distinct lines that have an earlier line within one edit."""
    keyed = lines.where("k0 IS NOT NULL").select("h", "g", "first", F.explode(F.array_distinct(F.array("k0", "k1", "k2", "k3"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    some = stash(keyed.join(shared, "key", "left_semi").select("h", "g", "first").distinct())
    at = some.groupBy(F.col("first.d").alias("__doc"), F.col("first.t").alias("__hash")).agg(F.collect_list(F.struct(F.col("first.l").alias("l"), "h", "g")).alias("at"))
    at = stash(at)
    docs = small_enough(at.select("__doc", "__hash"))
    rows = rows.join(docs, rows["__doc"].eqNullSafe(docs["__doc"]) & (rows["__hash"] == docs["__hash"]), "left_semi")
    found = rows.join(at, rows["__doc"].eqNullSafe(at["__doc"]) & (rows["__hash"] == at["__hash"])).select(rows["__doc"], rows["__hash"], F.split("__text", "\n").alias("s"), "at")
    found = found.select("__doc", "__hash", "s", F.explode("at").alias("a")).select(
        "a.h", "a.g", F.struct(F.col("__doc").alias("d"), F.col("__hash").alias("t"), F.col("a.l").alias("l")).alias("first"), words(F.element_at("s", F.col("a.l") + 1)).alias("w")
    )
    found = stash(found.dropDuplicates(["h", "g"]))  # repeated rows have the same lines
    each = found.select("h", "g", "first", F.size("w").alias("n"), F.posexplode("w").alias("i", "x"))
    here, moved = (F.shiftright(F.xxhash64("x", F.col("i") - k), 24) for k in (0, 1))
    own = Window.partitionBy("h", "g").orderBy("i")
    before = F.coalesce(F.sum("a").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the sum after a place is the whole sum less the sum up to it
    upto, whole_sum = F.sum("b").over(own.rowsBetween(Window.unboundedPreceding, 0)), F.sum("b").over(Window.partitionBy("h", "g"))
    each = each.select("h", "g", "first", "n", "i", here.alias("a"), moved.alias("b"))
    summed = each.select("h", "g", "first", "n", "i", "a", (before + whole_sum - upto).alias("cut"), (before + F.col("a")).alias("full"))
    keys = summed.select("h", "g", "first", F.explode(F.array_compact(F.array(
        F.struct(F.col("cut").alias("key"), (F.col("n") - 1).alias("m"), F.col("i")),
        F.when(F.col("i") == F.col("n") - 1, F.struct(F.col("full").alias("key"), F.col("n").alias("m"), F.lit(-1).alias("i"))),
    ))).alias("k")).select("h", "g", "first", "k.key", "k.m", "k.i")
    keys = stash(keys)  # read twice; i is the place deleted, -1 for the whole line
    low = keys.groupBy("key", "m").agg(F.min("first").alias("low"), F.min(F.when(F.col("i") < 0, F.col("first"))).alias("whole"), F.count("*").alias("c")).where("c > 1").drop("c")
    shares = stash(keys.join(low, ["key", "m"]))
    alike = shares.where("i >= 0").groupBy("key", "m", "i").agg(F.min("first").alias("alike"), F.count("*").alias("c")).where("c > 1").drop("c")
    held = shares.select("h", "g", "first", F.when(F.col("i") < 0, F.col("low")).otherwise(F.col("whole")).alias("low"))
    held = held.union(shares.join(alike, ["key", "m", "i"]).select("h", "g", "first", "alike"))
    pairs = held.where(F.col("low") < F.col("first")).select("h", "g", "low").distinct()
    a = found.select("h", "g", F.col("w").alias("x"))
    b = found.select(F.col("first").alias("low"), F.col("w").alias("y"))
    n, m = F.size("x"), F.size("y")
    # equal words from the front and, past them, from the back: one edit leaves all but one word of the longer line
    p = F.aggregate(F.sequence(F.lit(1), F.least(n, m)), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.get("x", i - 1) == F.get("y", i - 1)), i).otherwise(k))
    s = F.aggregate(F.sequence(F.lit(1), F.least(n, m)), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.get("x", n - i) == F.get("y", m - i)), i).otherwise(k))
    near = pairs.join(a, ["h", "g"]).join(b, "low").where((F.abs(n - m) <= 1) & (p + s >= F.greatest(n, m) - 1))
    out = stash(near.select("h", "g").distinct())
    unstash(some, found, at, keys, shares)
    return out


def dedup_lines(df: DataFrame) -> DataFrame:
    """The input with repeated and nearly repeated lines taken out of text, and how many in __dropped_lines."""
    rows = df.select(F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__hash"), F.col("text").alias("__text"))
    spots = stash(places(rows))
    lines = stash(first_lines(spots))
    near = near_lines(rows, lines)
    # of a line that stands in one place and has no near line nothing is dropped
    gone = lines.select("h", "g", "first", "places").join(near.withColumn("near", F.lit(True)), ["h", "g"], "left").where("places > 1 OR near")
    place = F.struct(F.col("__doc").alias("d"), F.col("__hash").alias("t"), F.col("l"))
    dropped = spots.select("__doc", "__hash", "l", "h", "g").join(gone, ["h", "g"]).where(F.coalesce(F.col("near"), F.lit(False)) | (place > F.col("first")))
    lists = stash(dropped.groupBy("__doc", "__hash").agg(F.sort_array(F.collect_set("l")).alias("__gone")).withColumnsRenamed({"__doc": "__d", "__hash": "__h"}))
    unstash(spots, lines)
    # the input's row is one column, so no name of it meets one of ours
    wide = df.select(F.struct(*df.columns).alias("__row"), F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__hash"))
    this = F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__hash") == F.col("__h"))
    docs = small_enough(lists.select("__d", "__h"))
    names = [c for c in df.columns if c != "__dropped_lines"]
    # only documents that lose lines are brought to their lists
    whole = wide.join(docs, this, "left_anti").select(*(F.col("__row")[c].alias(c) for c in names), F.lit(0).alias("__dropped_lines"))
    cut = wide.join(docs, this, "left_semi").join(lists, this)
    cut = cut.withColumn("__lines", F.split(F.col("__row")["text"], "\n"))
    cut = cut.withColumn("__stay", F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone"))
    text = F.array_join(F.transform("__stay", lambda i: F.get("__lines", i)), "\n")
    return whole.unionByName(cut.select(*(text.alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in names), F.size("__gone").alias("__dropped_lines")))
