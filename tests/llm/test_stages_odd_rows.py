"""Nulls, repeated and empty rows, clashing columns and empty tables through every stage of the pipeline."""

import corpus_pipeline

WORDS = [f"word{k}" for k in range(3000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, at string, component_id string, start string, length string"


def text(k, n=40):
    return " ".join(WORDS[(k * 97 + j * 31) % 3000] for j in range(n))


def rows():
    shared = "\n".join(text(500 + k, 12) for k in range(3))
    own = [(k, text(k)) for k in range(1, 25)]
    odd = [(1, text(1)), (30, None), (31, ""), (32, " \n\n "), (33, "one"), (33, "one"), (None, text(60)), (None, None), (-4, text(61)), (40, text(62) + "\n" + shared), (41, text(63) + "\n" + shared), (41, text(63) + "\n" + shared), (50, " ".join(f"long{j}" for j in range(40_000))), (51, text(65) + " " + "x" * 300_000)]  # a field of some 30 labels knows nothing of a giant word alone
    bad = [(60 + k, text(70 + k, 20) + " scum vile scum") for k in range(8)]
    return own, odd, bad


def test_odd_rows_through_all_stages(spark, tmp_path):
    sf = str(tmp_path)
    own, odd, bad = rows()
    given = [(i, t, None, None, None, None, "r", "a", "c", "s", "l") for i, t in own + odd + bad]
    spark.createDataFrame(given, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, None, int(i >= 60)) for i in range(1, 68)] + [(None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, text(5, 15)), (2, None), (3, ""), (None, text(6, 15))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    order = lambda found: sorted(((r.doc_id, r.text) for r in found), key=str)
    stages = dict(corpus_pipeline.STAGES)

    out = stages["toxicity"](spark, now, sf)
    assert out.columns == now.columns and order(out.collect()) == sorted(own + odd, key=str)
    now = spark.createDataFrame(out.collect(), now.schema)

    lines = stages["line_dedup"](spark, now, sf)
    found = lines.collect()
    want = [(i, text(63) if i == 41 else t) for i, t in own + odd]
    assert lines.columns == now.columns and order(found) == sorted(want, key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.row == "r" for r in found)
    now = spark.createDataFrame(found, now.schema)

    near = stages["near_dedup"](spark, now, sf)
    assert near.columns == now.columns and order(near.collect()) == sorted(want, key=str)

    clean = stages["decontamination"](spark, now, sf)
    assert clean.columns == now.columns and order(clean.collect()) == sorted((x for x in want if x[0] != 5), key=str)

    pieces = stages["packing"](spark, now, sf).collect()
    total = {}
    for r in pieces:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert set(total) == {i for i, _ in want} and total[30] == total[31] == 1 and total[33] % 2 == 0


def test_empty_tables_through_all_stages(spark, tmp_path):
    sf = str(tmp_path)
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == docs.columns
