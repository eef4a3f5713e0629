import random

from pyspark.sql import functions as F

from textweir.operators import matching


def test_meetings_are_made_behind_the_exchange(spark):
    """Each word of a document travels once, not once for each query word that it meets."""
    random.seed(2)
    some = lambda: random.choice([None, 0, 1, 2, 3])
    dwords = spark.createDataFrame([(d, d, f"word{w}") for d in [*range(40), None] for w in random.sample(range(60), 25)], "doc_id long, seq long, word string")
    pairs = [(f"word{a}", f"query{b}", some(), some()) for a in range(50) for b in random.sample(range(30), 12)]
    matches = spark.createDataFrame(pairs, "doc_word string, query_word string, hamming int, edit int")
    got = matching.best_distances(dwords, matches)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.find("Generate explode(codes") < plan.find("Exchange hashpartitioning(doc_id")
    met = dwords.join(matches, dwords.word == matches.doc_word)
    want = met.groupBy("doc_id", "query_word").agg(F.min("hamming").alias("best_hamming"), F.min(F.least("edit", "hamming")).alias("best_edit"))
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert matching.best_distances(dwords, matches.where("false")).count() == 0
