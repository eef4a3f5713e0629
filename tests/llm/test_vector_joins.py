import random

from textweir.llm import embeddings


def test_no_table_of_cells_is_broadcast(spark, monkeypatch):
    """A vector has 128 cells; Spark sizes tables of cells by the vectors' files, so no join may follow that size."""
    random.seed(3)
    base = [[random.gauss(0, 1) for _ in range(16)] for _ in range(60)]
    rows = [(i, [x + 0.01 * (i // 60) * random.gauss(0, 1) for x in base[i % 60]]) for i in range(120)]
    plans = {}

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, label)

    stored = embeddings.stored
    monkeypatch.setattr(embeddings, "stored", kept)
    out = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    plans["out"] = out._jdf.queryExecution().executedPlan().toString()
    assert {r.vec_id: r.component_id for r in out.collect()} == {i: i % 60 for i in range(120)}
    assert all("SortMergeJoin" in plans[x] and "BroadcastExchange" not in plans[x] for x in ("met", "links"))
    assert plans["out"].count("SortMergeJoin") >= 2  # with the components and the counts
