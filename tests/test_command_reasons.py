from collections import Counter

import duckdb
from textweir.jobs import queries
from textweir.sources import commands as cmd


def test_reasons_are_those_of_the_sql(spark, tmp_path):
    """Repeated rows share their place, so one of them is good; texts may be null, blank or of one word."""
    texts = ["golden things", "golden things", None, "", "   ", "silver", "  silver  ring ", "oh", "Von den", "GOLDEN", "go\nld", "x" * 40, "İiii kept"]
    docs = [(i, t) for i, t in enumerate(texts, 30)] + [(30, "golden things")] * 3 + [(35, "silver"), (32, None), (33, ""), (31, "other words"), (61, "KEPT WORDS"), (63, "İiii kept")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(0, "silver golden"), (1, "golden silver"), (2, "one"), (3, ""), (4, None), (5, "Ah!"), (6, " seven words"), (7, "an ox"), (8, "one"), (9, "golden rings"), (12, "two rings"), (12, "two rings"), (15, "a rings"), (17, "ein")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = Counter(con.execute(queries.SQL["validate_commands"]).fetchall())
    got = Counter(map(tuple, queries.validate_commands(spark, str(tmp_path)).collect()))
    assert got == want and got[(60, "m", 30, "good")] == 1 and got[(60, "m", 30, "id used before")] == 3


def test_of_equal_places_one_is_good(spark):
    log = spark.createDataFrame([(7, f"m {i % 3} 1 word{'abc'[i % 3]}") for i in range(60)], "seq long, value string").repartition(5)
    good, bad = cmd.validate_commands(cmd.parse_commands(log))
    assert sorted(r.id for r in good.collect()) == [0, 1, 2] and bad.where("reason = 'id used before'").count() == 57
