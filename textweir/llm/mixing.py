"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each document gets a rate r, how often it is taken on average. Among all rates up to MOST whose taken words sum to the
target of each source, those of least relative entropy to taking each document once are r = min(MOST, exp(l * z)): l is
the source's dual variable, z the document's size over its source's mean size. Newton steps on the logarithm of the
taken words find all l at once; each step is one distributed sum over (source, size) with the number of documents, and a step
that leaves what is known to hold the solution is replaced by a bisection.

Rates are then rounded into whole copies: along falling sizes the copies follow the running sum of the rates, and what
the words of a source still miss or exceed is made up by single copies, largest sizes first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textweir.llm.shared import dropped, prepared, stored, table

#: A document is taken so often at most; targets end at so many times their source's size.
MOST = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: Newton steps end when all sources are so near their targets; each step at worst halves an interval.
NEAR, STEPS = 1e-9, 100
#: Passes that make up what rounding leaves; each at least halves it, as long as there are documents small enough.
MENDS = 8
#: Parts that documents of one source and size are dealt to, so that copies of one text do not meet in one task.
PARTS = 1024

#: A separator is a space or one of U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, mark): size in words, mark a hash of id and text."""
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(id_col).cast("long"), text).alias("mark"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from the table of sized().

    Sources in order of code points, null last, have the weights in turn and share all words by them; a target ends at
    `most` times its source's size, and the rest is shared again by weight among the others. So every target is
    min(most * size, level * weight), with one level; it follows from the sources in order of most * size / weight by
    running sums, over a row for each source.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int")).cast("long")
    ends = (F.col("source_size") * most).alias("ends")
    rows = own.select("source", "source_size", weight.alias("weight"), ends)
    by_fill, everything = Window.orderBy(F.col("ends") / F.col("weight"), F.col("source").asc_nulls_last()), Window.partitionBy()
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    filled, left = F.coalesce(F.sum("ends").over(before), F.lit(0)), F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) - filled) / left
    rows = rows.select("*", level.alias("level"))
    # The first source that the level does not fill up, and all behind it, stop at that level.
    stop = F.min_by(F.when(F.col("ends") > F.col("level") * F.col("weight"), F.col("level")), F.when(F.col("ends") > F.col("level") * F.col("weight"), F.col("ends") / F.col("weight"))).over(everything)
    target = F.when(stop.isNull(), F.col("ends")).otherwise(F.least(F.col("ends").cast("double"), stop * F.col("weight")))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def tilts(cells: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """(source, mean, tilt): the dual variable of each source that holds words, from cells (source, size, n).

    tilt is infinite where all documents have to be taken `most` times, minus infinite where none is.
    """
    full = cells.where("size > 0")
    # The smallest size has the rate nearest to 1, which bounds the tilt on either side.
    own = full.groupBy(F.col("source").alias("s")).agg(F.min("size").alias("least"), F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"))
    own = own.join(targets, _same("s", "source")).select("source", "target", "words", (F.col("words") / F.col("docs")).alias("mean"), (F.col("least") * F.col("docs") / F.col("words")).alias("z"))
    shrink = F.log(F.col("target") / F.col("words")) / F.col("z")
    inf = float("inf")
    now = own.select(
        "source", "target", "mean",
        F.when(F.col("target") <= 0, -inf).when(F.col("target") >= F.col("words") * most, inf).otherwise(0.0).alias("tilt"),
        F.when(F.col("target") < F.col("words"), shrink).otherwise(0.0).alias("lo"), F.when(F.col("target") > F.col("words"), math.log(most) / F.col("z")).otherwise(0.0).alias("hi"), F.lit(1.0).alias("off"))
    now = stored(now, "tilts")
    for _ in range(STEPS):
        z = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("tilt") * z, F.lit(math.log(most))))
        words = F.col("size") * F.col("n") * rate
        slope = F.when(F.col("tilt") * z < math.log(most), words * z).otherwise(0.0)
        solving = now.where((F.abs("tilt") < inf) & (F.col("off") > NEAR))
        sums = full.join(solving.select(F.col("source").alias("s"), "tilt", "mean"), _same("source", "s")).groupBy("s").agg(F.sum(words).alias("got"), F.sum(slope).alias("slope"))
        off = F.abs(F.col("got") / F.col("target") - 1)
        lo, hi = F.when(F.col("got") <= F.col("target"), F.col("tilt")).otherwise(F.col("lo")), F.when(F.col("got") >= F.col("target"), F.col("tilt")).otherwise(F.col("hi"))
        step = F.col("tilt") + F.log(F.col("target") / F.col("got")) * F.col("got") / F.col("slope")
        tried = now.join(sums, _same("source", "s"), "left").select("source", "target", "mean", "tilt", "got", "slope", F.when(F.col("got").isNull(), F.col("lo")).otherwise(lo).alias("lo"), F.when(F.col("got").isNull(), F.col("hi")).otherwise(hi).alias("hi"), F.when(F.col("got").isNull(), 0.0).otherwise(off).alias("off"))
        inside = (F.col("slope") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        tilt = F.when(F.col("off") <= NEAR, F.col("tilt")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)
        after = stored(tried.select("source", "target", "mean", tilt.alias("tilt"), "lo", "hi", "off"), "tilts")
        dropped(now)
        now = after
        if now.where(F.col("off") > NEAR).isEmpty():
            break
    return now.select("source", "mean", "tilt")


def _falling(columns: int = 1):
    return Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -columns)


def cell_copies(cells: DataFrame, targets: DataFrame, solved: DataFrame, most: int = MOST, mends: int = MENDS) -> DataFrame:
    """(source, size, n, rate, copies) of cells (source, size, n): copies for all n documents of a cell together.

    The running sum of n * rate along falling sizes is rounded down, so the copies up to any size are less than one short. Then
    each pass takes what the source's words miss (or exceed): it goes through the cells of at most that size, largest
    first, adding (or dropping) as many single copies as fit. A pass leaves less than its last cell's size.
    """
    whole = Window.partitionBy("source")
    t = targets.select(F.col("source").alias("ts"), "target")
    s = solved.select(F.col("source").alias("ss"), "mean", "tilt")
    rate = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(math.log(most))))
    exact = F.when(F.col("tilt") == float("inf"), F.lit(float(most))).when(F.col("tilt") == -float("inf"), 0.0).otherwise(rate)
    rows = cells.where("size > 0").join(t, _same("source", "ts")).join(s, _same("source", "ss")).select("source", "size", "n", "target", exact.alias("rate"))
    want = F.col("n") * F.col("rate")
    upto = F.sum(want).over(whole.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("*", F.floor(upto + 1e-6).alias("upto"))
    copies = F.col("upto") - F.coalesce(F.lag("upto").over(whole.orderBy(F.col("size").desc())), F.lit(0))
    rows = rows.select("source", "size", "n", "target", "rate", F.least(copies, F.col("n") * most).alias("copies"))
    for _ in range(mends):
        rows = rows.withColumn("miss", F.round(F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole)).cast("long"))
        sign = F.signum(F.col("miss").cast("double")).cast("long")
        room = F.when(F.col("size") > F.abs("miss"), 0).when(sign > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
        rows = rows.withColumns({"room": room, "sign": sign})
        rows = rows.withColumn("before", F.coalesce(F.sum(F.col("room") * F.col("size")).over(_falling()), F.lit(0)))
        fits = F.floor((F.abs("miss") - F.col("before")) / F.col("size"))
        moved = F.greatest(F.least(fits, F.col("room")), F.lit(0))
        rows = rows.select("source", "size", "n", "target", "rate", (F.col("copies") + F.col("sign") * moved).alias("copies"))
    return rows.drop("target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, mark, source, size, source_size, target, rate, copies.

    Sizes are counted in words; targets as in source_targets(). The words of a source's copies miss its target by less than
    its smallest documents' size, where small documents are left to make it up; no document has more than `most` copies.
    Which documents of one source and size get a copy more is settled by hashes of id and text, so runs agree, however
    the rows are split. A null text is empty and like all texts without words has no copies; null is a source of its own,
    as is the empty one; null ids stay null; repeated rows are documents of their own; other columns are ignored,
    whatever their names; an empty table gives an empty result, a table without words no copies. Texts are read once and
    never shuffled. A row for each source is sorted in one task, and a source's sizes are summed in order in one.
    """
    prepared(docs.sparkSession)
    sizes = stored(sized(docs, id_col, text_col, source_col), "sizes")
    targets = stored(source_targets(sizes, weights, most), "targets")
    cells = stored(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    planned = cell_copies(cells, targets, tilts(cells, targets, most), most)
    # A cell's copies go to parts of its documents in proportion, a part's to its documents in order of their hashes.
    part = F.pmod("mark", F.lit(PARTS)).alias("part")
    parts = sizes.groupBy("source", "size", part).agg(F.count("*").alias("m"))
    upto = Window.partitionBy("source", "size").orderBy("part")
    parts = parts.select("*", F.sum("m").over(upto).alias("upto"))
    p = planned.select(F.col("source").alias("ps"), F.col("size").alias("pz"), "n", "rate", "copies")
    share = lambda x: F.expr(f"cast(copies as decimal(38,0)) * cast({x} as decimal(19,0)) div n")
    dealt = parts.join(p, _same("source", "ps") & (F.col("size") == F.col("pz")), "left").select(F.col("source").alias("ds"), F.col("size").alias("dz"), F.col("part").alias("dp"), "m", "rate", (share("upto") - share("upto - m")).alias("own"))
    rows = sizes.withColumn("part", part).join(dealt, _same("source", "ds") & (F.col("size") == F.col("dz")) & (F.col("part") == F.col("dp")))
    nth = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("mark", "doc_id"))
    copies = F.coalesce(F.expr("own div m") + F.when(nth <= F.col("own") % F.col("m"), 1).otherwise(0), F.lit(0)).cast("long")
    rows = rows.select("doc_id", "mark", "source", "size", F.coalesce("rate", F.lit(0.0)).alias("rate"), copies.alias("copies"))
    t = targets.withColumnRenamed("source", "ts")
    return rows.join(t, _same("source", "ts")).select("doc_id", "mark", "source", "size", "source_size", "target", "rate", "copies")


def copied(docs: DataFrame, mixture: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, each as often as mix() says, with a column `copy` from 0; repeated rows of docs are told apart by nothing, so
    each of them stands for all and has their copies together, under numbers of its own."""
    mark = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    times = mixture.groupBy(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark")).agg(F.sum("copies").alias("times")).where("times > 0")
    rows = docs.select(F.col(id_col).cast("long").alias("own_id"), mark.alias("own_mark"), F.struct("*").alias("row")).dropDuplicates(["own_id", "own_mark"])
    met = rows.join(times, F.col("own_id").eqNullSafe(F.col("of_id")) & (F.col("own_mark") == F.col("of_mark")))
    return met.select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("copy")).select("row.*", "copy")


def op11_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixture.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
