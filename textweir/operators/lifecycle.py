"""Query lifetimes on the log's clock."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textweir.sources.tables import stored

#: Points of the clock that one task numbers.
RANGE_ROWS = 1_000_000


def query_lifetimes(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """starts with end_seq: the first end after the start, null if there is none. Ends of unknown queries fall away."""
    e = ends.select("query_id", F.col("seq").alias("end_seq"))
    s = starts.withColumnRenamed("seq", "start_seq")
    after = s.select("query_id", "start_seq").join(e, "query_id").where("end_seq > start_seq").groupBy("query_id").agg(F.min("end_seq").alias("end_seq"))
    return s.join(after, "query_id", "left")


def active(seq):
    """Whether a query is active at a point of the clock (a column)."""
    return (F.col("start_seq") < seq) & (F.col("end_seq").isNull() | (seq < F.col("end_seq")))


def active_queries(lifetimes: DataFrame, seq: int) -> DataFrame:
    """Queries that started before seq and have not ended by then."""
    return lifetimes.where(active(F.lit(seq)))


def dyadic(first: Column, behind: Column, levels: int) -> Column:
    """The numbers first..behind - 1 as array of (level, block), block b of level l being b * 2^l to (b + 1) * 2^l - 1.

    They are the fewest such blocks, at most two of a level: at each level what is left begins at the next even block
    and ends at the last one, and the odd blocks before and behind are taken. `behind` is at most 2^levels.
    """
    def odd(level: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        lo, hi = F.call_function("shiftright", first + width - 1, level), F.call_function("shiftright", behind, level)
        block = lambda b, taken: F.when((lo < hi) & taken, F.struct(level.alias("level"), b.alias("block")))
        return F.array(block(lo, lo % 2 == 1), block(hi - 1, hi % 2 == 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), odd)))


def active_at_document(documents: DataFrame, lifetimes: DataFrame) -> DataFrame:
    """(doc_id, query_id) of all documents and the queries active at their arrival.

    A range join as an equi-join: a lifetime, cut to the documents' clock, is made of at most two dyadic blocks of the clock of
    each size, and a document looks for the block of each size that it lies in. With a clock of n ticks, that is 2 log2(n)
    rows a query and log2(n) a document. The result is as large as the sum of active sets; the matching operators carry
    the condition in their word join instead.
    """
    clock = documents.agg(F.min("seq").alias("least"), F.max("seq").alias("most")).first()  # one row
    if clock.least is None:
        return documents.select("doc_id").join(lifetimes.select("query_id"), F.lit(False))
    n = clock.most - clock.least + 1
    levels = (n - 1).bit_length()
    tick = lambda seq: seq - F.lit(clock.least)
    first = F.greatest(tick(F.col("start_seq")) + 1, F.lit(0).cast("long"))
    behind = F.least(F.coalesce(tick(F.col("end_seq")), F.lit(n)), F.lit(n))
    q = lifetimes.select("query_id", first.alias("first"), behind.alias("behind")).where("first < behind")
    q = q.select("query_id", F.explode(dyadic(F.col("first"), F.col("behind"), levels)).alias("d")).select("query_id", "d.level", "d.block")
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    d = documents.select("doc_id", tick(F.col("seq")).alias("tick"), level).select("doc_id", "level", F.call_function("shiftright", F.col("tick"), F.col("level")).alias("block"))
    return d.join(q, ["level", "block"]).select("doc_id", "query_id")


def assign_epochs(commands: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """commands with the number of query changes up to and including each, without one task seeing all rows.

    The points of the clock, each with its changes, are counted and dealt to ranges of about `rows` points (drawn from a
    sample, then written, so that both sums below see the same). Each range's changes are summed, and the ranges' running sums, a row
    each, are added to running sums within them. Commands get their point's number by an equi-join. Commands of one seq
    share their number; those without a seq have none and count for nothing.
    """
    change = F.col("cmd").isin("s", "e").cast("int")
    clock = stored(commands.where("seq is not null").groupBy("seq").agg(F.sum(F.coalesce(change, F.lit(0))).alias("n")), "clock")
    ranges = max(1, -(-clock.count() // rows))
    ranged = stored(clock.repartitionByRange(ranges, "seq").withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("part").agg(F.sum("n").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("seq"))
    points = ranged.select("seq", "part", within.alias("within")).join(F.broadcast(before), "part").select("seq", (F.col("within") + F.col("before")).alias("epoch"))
    return commands.join(points, "seq", "left").select(*commands.columns, "epoch")
