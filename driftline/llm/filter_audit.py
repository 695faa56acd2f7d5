"""How text filters interact: what each removes, alone and behind others, in every order.

Every document gets a mask of the filters that it fails. Counts by part and mask
hold all that any order of the filters needs, so the orders cost nothing that
grows with the documents.

The duplicate filter finds equal texts by refining a partition: texts are split
by their length in code points, then by the hash of their first block, of their
second, and so on, blocks growing eightfold; classes of one text are dropped
before the next split. What is left in one class is compared as whole texts. All
hashes come from one scan, so the rounds move ids and hashes alone, and the texts
of classes that are left move once, one for each class and task.

Defined cases: a null text is empty; a null part is the empty string; a row with
a null id is never a later copy nor what others are copies of; an id on several
rows counts once for each, and copies among rows of one id are not later copies;
several labels of one id count as good if any is, toxic likewise; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import stored

#: Code points of the first block, and how much larger each next block's end is.
FIRST_BLOCK, GROWTH = 64, 8
#: Where blocks begin; the last one holds whatever a string can.
STARTS = [0, *(FIRST_BLOCK * GROWTH**i for i in range(9))]
WORD_BREAK = r"[\x20\x09-\x0D]+"


def block_hashes(text: Column) -> Column:
    """Hashes of a text's blocks, as many as its length asks for."""
    end = lambda start: F.greatest(F.lit(FIRST_BLOCK), start * GROWTH)
    starts = F.filter(F.array(*map(F.lit, STARTS[:-1])), lambda s: s < F.length(text))
    return F.transform(starts, lambda s: F.xxhash64(F.substr(text, s + 1, end(s.cast("long")).cast("int") - s)))


def _several(rows: DataFrame) -> DataFrame:
    """Rows whose class holds another row."""
    return rows.join(rows.groupBy("class").agg(F.count("*").alias("n")).filter("n > 1").select("class"), "class", "left_semi")


def later_copies(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """Distinct (doc_id, signature) of the rows whose text a smaller id has.

    ``docs`` has (doc_id, text); ``signed`` has a row (doc_id, signature) for
    each of them, with :func:`signature` of its text.
    """
    live = signed.filter("doc_id IS NOT NULL").withColumn("class", F.xxhash64("signature.length"))
    live, i, blocks = stored(_several(live)), 0, 1
    while i < blocks:
        if not i:
            blocks = live.agg(F.max(F.size("signature.blocks"))).first()[0] or 0
        block = F.get("signature.blocks", F.lit(i))
        live, i = stored(_several(live.withColumn("class", F.when(block.isNotNull(), F.xxhash64("class", block)).otherwise(F.col("class"))))), i + 1
    live = live.distinct()
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("signature", signature(F.col("text")))
    whole = texts.join(live.hint("merge"), ["doc_id", "signature"]).groupBy("class", "signature", "text").agg(F.min("doc_id").alias("first"))
    found = stored(whole.groupBy("class", "signature").agg(F.min("first").alias("first"), F.count("*").alias("texts")))
    same = live.join(found.filter("texts = 1"), ["class", "signature"]).filter("doc_id > first").select("doc_id", "signature")
    if found.filter("texts > 1").isEmpty():
        return same
    mixed = texts.join(live.join(found.filter("texts > 1").select("class", "signature"), ["class", "signature"], "left_semi"), ["doc_id", "signature"])
    firsts = mixed.groupBy("class", "signature", "text").agg(F.min("doc_id").alias("first"))
    return same.union(mixed.join(firsts, ["class", "signature", "text"]).filter("doc_id > first").select("doc_id", "signature").distinct())


def signature(text: Column) -> Column:
    return F.struct(F.length(text).alias("length"), block_hashes(text).alias("blocks"))


def prose_faults(text: Column, words: Column) -> dict[str, Column]:
    """Filters on one text, by letter: too short, too repetitive, too many capitals, symbols."""
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)) * 100 < n * 50,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 2,
        "D": text.rlike(r"[#$%&*|]"),
    }


def masked(docs: DataFrame, faults=prose_faults) -> DataFrame:
    """(doc_id, part, mask) of every row; bit i of the mask is the i-th filter, the last one that of later copies."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    words = F.filter(F.split("text", WORD_BREAK), lambda w: w != "")
    told = faults(F.col("text"), F.col("words"))
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(told.values())), F.lit(0))
    seen = stored(rows.withColumn("words", words).select("doc_id", "part", bits.alias("bits"), signature(F.col("text")).alias("signature")))
    copies = later_copies(rows, seen.select("doc_id", "signature")).withColumn("copy", F.lit(1 << len(told)))
    return seen.join(copies, ["doc_id", "signature"], "left").select("doc_id", "part", (F.col("bits") + F.coalesce("copy", F.lit(0))).alias("mask"))


def audit(masks: DataFrame, labels: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """A row for each part, order of ``letters`` and step, from (doc_id, part, mask) and (doc_id, quality, toxic)."""
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    cells = masks.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # one for each mask at most
    orders = ",".join(map("".join, permutations(letters)))
    rows = parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    # the filters of earlier steps, and the step's own, as masks
    bits = lambda among: sum((F.when(F.contains(among, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    rows = rows.withColumns({"before": bits(F.substr("filter_order", F.lit(1), F.col("step") - 1)), "own": bits(F.substr("filter_order", "step", F.lit(1)))})
    before, own = F.col("before"), F.col("own")
    hits = lambda c, mask: c["mask"].bitwiseAND(mask) != 0

    def count(which, of=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda total, c: total + of(c))

    removed = lambda c: hits(c, own) & ~hits(c, before)
    # of a document's faults each comes first in the same share of the orders
    share = lambda c: (F.lit(factorial(len(letters))) / F.bit_count(c["mask"])).cast("long") * c["n"]
    return rows.select(
        "part", "filter_order", "step",
        count(lambda c: ~hits(c, before.bitwiseOR(own))).alias("kept"),
        count(removed).alias("removed"),
        count(lambda c: hits(c, own) & hits(c, before)).alias("redundant"),
        count(lambda c: c["mask"] == own).alias("unique_fails"),
        count(removed, lambda c: c["good"]).alias("good_lost"),
        count(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        count(lambda c: hits(c, own), share).alias("shapley"),
    )
