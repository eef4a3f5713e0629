import random

from pyspark.sql import functions as F

from textweir.operators import lifecycle
from textweir.sources.tables import scratch


def test_epochs_of_a_long_log(spark):
    """More commands than a sampler of ranges holds, a third of them changes, dealt anew out of order."""
    log = spark.range(1, 150_001, 1, 6).select(((F.col("id") * 48_271) % 150_001).alias("seq")).withColumn("cmd", F.when(F.col("seq") % 3 == 0, "s").otherwise("m")).withColumn("id", F.col("seq") * 7)
    assert log.select("seq").distinct().count() == 150_000
    got = lifecycle.assign_epochs(log, 20_000).select("seq", "cmd", "id", "epoch")
    assert got.count() == 150_000 and got.where((F.col("epoch") != F.floor(F.col("seq") / 3)) | (F.col("id") != 7 * F.col("seq"))).count() == 0
    ties = spark.createDataFrame([(s, c) for s in range(40) for c in "sme"], "seq long, cmd string")
    assert all(r.epoch == 2 * (r.seq + 1) for r in lifecycle.assign_epochs(ties, 7).collect())


def test_ranges_grow_in_number_not_in_size(spark):
    for n in (3000, 30_000):
        log = spark.range(n).select((F.col("id") * F.col("id")).alias("seq"), F.lit("e").alias("cmd"), "id")
        with scratch(spark):
            got = lifecycle.assign_epochs(log, 1000)
            assert got.where("epoch <> id + 1").isEmpty()
            ranges = [f for f in got.inputFiles() if "ranges-" in f]
        assert n / 1000 * 0.9 <= len(ranges) <= n / 1000
    none = spark.createDataFrame([(None, "s", 1), (5, "s", 2), (7, None, 3)], "seq long, cmd string, id long")
    assert {r.id: r.epoch for r in lifecycle.assign_epochs(none).collect()} == {1: None, 2: 1, 3: 1}


def test_dyadic_blocks(spark):
    """Each number once, in at most two blocks of a level."""
    rows = spark.createDataFrame([(a, b) for a in range(34) for b in range(a, 34)], "a long, b long").select("a", "b", lifecycle.dyadic(F.col("a"), F.col("b"), 6).alias("d"))
    for r in rows.collect():
        assert sorted(x for level, block in r.d for x in range(block << level, block + 1 << level)) == list(range(r.a, r.b))
        assert len(r.d) <= 2 * max((r.b - r.a).bit_length(), 1) and len({x.level for x in r.d}) * 2 >= len(r.d)


def test_active_sets_by_brute_force(spark):
    random.seed(5)
    for spread in (1, 9, 10**12):
        clock = [random.choice([random.randint(0, 300), random.randint(0, 5)]) * spread for _ in range(90)]
        q = [(i, s, random.choice([None, s - 1, s, s + spread, s + random.randint(0, 200) * spread])) for i, s in enumerate(random.sample(clock, 60))]
        docs, life = spark.createDataFrame(list(enumerate(clock)), "doc_id long, seq long"), spark.createDataFrame(q, "query_id long, start_seq long, end_seq long")
        got = sorted(map(tuple, lifecycle.active_at_document(docs, life).collect()))
        assert got == sorted((d, i) for d, t in enumerate(clock) for i, s, e in q if s < t and (e is None or t < e))
    assert lifecycle.active_at_document(docs.where("false"), life).columns == ["doc_id", "query_id"]
