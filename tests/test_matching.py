import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textweir.functions.distance import edit_distance, hamming_distance
from textweir.operators import lifecycle, matching, verify, wordjoin
from textweir.sources import commands as cmd
from textweir.streaming import streams

LOG = """s 1 0 0 2 silver ring
s 2 1 1 1 ringo
s 3 2 2 2 silver golden
m 1 3 silver rings ring
m 2 2 sliver goldens
m 3 1 nothing
r 1 2 1 2
r 2 1 3
r 3 0
e 1
s 4 2 1 1 rings
s 5 2 0 2 ring ring
m 4 3 silver ring rings
r 4 3 2 4 5
e 2
e 99
s 6 1 3 1 abcdefghijklmnopqrstuvwxyzabcde
m 5 3 abcdefghijklmnopqrstuvwxyzabxyz ring ring
m 6 1 abcdefghijklmnopqrstuvwxyzabxy
r 5 3 4 5 6
r 6 0
e 3""".split("\n")

BAD = ["x 1", "s 7 0", "s 8 0 1 1 ring", "s 9 1 4 1 ring", "s 10 1 1 1 abc", "s 11 0 0 6 aaaa bbbb cccc dddd eeee ffff", "m 7 1 Ring", "s 2 0 0 1 ring", "r 9 2 1"]


def lines(spark, rows):
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(rows)], "seq long, value string")


def parsed(spark, rows=LOG):
    return cmd.parse_commands(lines(spark, rows))


def results_of(p):
    docs = cmd.parse_documents(p)
    life = lifecycle.query_lifetimes(cmd.parse_starts(p), cmd.parse_ends(p))
    return docs, life, matching.document_results(docs, matching.match_documents(docs, life))


def test_golden_log(spark):
    p = parsed(spark)
    _, _, results = results_of(p)
    checked = verify.verify_results(results, cmd.parse_expected(p)).collect()
    assert len(checked) == 6 and all(r.status == "ok" for r in checked)


def test_verify_states(spark):
    r = spark.createDataFrame([(1, 1, [5]), (2, 0, []), (2, 0, []), (3, 1, [7]), (9, 0, [])], "doc_id long, num_res int, query_ids array<long>")
    e = spark.createDataFrame([(1, 1, [5]), (2, 0, []), (3, 2, [7, 8]), (4, 0, [])], "doc_id long, num_res int, query_ids array<long>")
    got = {x.doc_id: (x.status, x.missing_ids, x.extra_ids) for x in verify.verify_results(r, e).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "ok", 2: "twice", 3: "wrong", 4: "missing", 9: "unknown"} and got[3][1] == [8]


def test_quarantine(spark):
    good, bad = cmd.validate_commands(parsed(spark, [*LOG, *BAD]))
    assert good.count() == len(LOG)
    assert [r.reason for r in bad.orderBy("seq").collect()] == ["unknown command", "too few fields", "distance", "distance", "word length", "too many words", "characters", "id used before", "result count"]


def test_log_order_over_files_and_splits(spark, tmp_path):
    rows = [f"m {i} 1 word" for i in range(500)]
    for k in range(3):
        (tmp_path / f"part-{k}.txt").write_text("\n".join(rows[k * 100 : (k + 1) * 100 if k < 2 else 500]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = cmd.read_command_log(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.value for r in got] == rows and [r.seq for r in got] == list(range(1, 501))


def test_write_results(spark, tmp_path):
    r = spark.createDataFrame([(1, 2, [3, 4]), (2, 0, [])], "doc_id long, num_res int, query_ids array<long>")
    cmd.write_results(r, str(tmp_path / "t"), "text")
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "t")).collect()) == ["r 1 2 3 4", "r 2 0"]


VECTORS = [("aephtipte", "behavioural", 9), ("dreams", "anti", 6), ("abc", "abcdefghij", 7)]


def test_distance_vectors(spark):
    df = spark.createDataFrame(VECTORS, "a string, b string, want int")
    assert df.where(edit_distance(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    h = spark.createDataFrame([("rings", "ringo", 1), ("abcd", "dcba", 4), ("abcd", "abcd", 0), ("abcd", "abcde", None)], "a string, b string, want int")
    assert h.where(~hamming_distance(F.col("a"), F.col("b")).eqNullSafe(F.col("want"))).count() == 0


word = st.text("abc", min_size=4, max_size=7)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=5, deadline=None)
@given(st.sets(word, min_size=1, max_size=25), st.sets(word, min_size=1, max_size=25), st.integers(1, 3))
def test_joins_are_brute_force(spark, a, b, k):
    v, q = (spark.createDataFrame([(x,) for x in s], "word string") for s in (a, b))
    want = {(x, y, lev(x, y)) for x in a for y in b if lev(x, y) <= k}
    assert {tuple(r) for r in wordjoin.edit_word_join(v, q, k).collect()} == want
    assert {tuple(r) for r in wordjoin.edit_word_join(v, q, k, band_words=0).collect()} == want
    ham = {(x, y, sum(c != d for c, d in zip(x, y, strict=True))) for x in a for y in b if len(x) == len(y)}
    assert {tuple(r) for r in wordjoin.hamming_word_join(v, q, k).collect()} == {h for h in ham if h[2] <= k}


def test_first_word_candidates_are_a_superset(spark):
    docs, life, _ = results_of(parsed(spark))
    found = {tuple(r) for r in matching.match_documents(docs, life).collect()}
    wide = {tuple(r) for r in matching.first_word_candidates(matching.doc_words(docs), matching.query_words(life)).collect()}
    assert found and found <= wide


def test_types_make_the_whole(spark):
    docs, life, _ = results_of(parsed(spark))
    parts = matching.union_matches(matching.match_exact(docs, life), matching.match_hamming(docs, life), matching.match_edit(docs, life))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, matching.match_documents(docs, life).collect()))


@pytest.mark.parametrize("cuts", [[31], [3, 12, 31], [1, 5, 9, 13, 25, 31]])
def test_replay_equals_batch(spark, tmp_path, cuts):
    """Each part of the log is a run of its own that goes on from the checkpoint of the one before."""
    rows = [*BAD[:3], *LOG, *BAD[3:]]
    p = parsed(spark, rows)
    assert len(rows) == 31
    good, bad = cmd.validate_commands(p)
    want = {r.doc_id: r.query_ids for r in results_of(good)[2].collect()}
    schema = p.schema
    at = 0
    for i, c in enumerate(cuts):
        p.where((F.col("seq") > at) & (F.col("seq") <= c)).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        at = c
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        streams.replay_stream(stream, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = streams.delivered(spark, str(tmp_path / "out")).collect()
    assert len(got) == len(want) and {r.doc_id: r.query_ids for r in got} == want
    refused = streams.refused(spark, str(tmp_path / "state"))
    assert sorted((r.seq, r.reason) for r in refused.collect()) == sorted((r.seq, r.reason) for r in bad.collect())


def test_epochs_and_empty_tables(spark):
    p = parsed(spark)
    got = [r.epoch for r in lifecycle.assign_epochs(p, 5).orderBy("seq").collect()]
    n, want = 0, []
    for line in LOG:
        n += line[0] in "se"
        want.append(n)
    assert got == want
    docs, life, results = results_of(p.where("false"))
    assert results.count() == 0 and matching.match_documents(docs, life).count() == 0


def exchanges(df):
    """The exchanges of rows, as the plan has them before it runs; broadcasts left out."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if " Exchange " in x]


def test_hits_are_dealt_once_by_document(spark):
    """From hits to results per document, one exchange; the others are of words and word pairs."""
    docs, life, _ = results_of(parsed(spark))
    results = matching.document_results(docs, matching.match_documents(docs, life))
    assert sum("doc_id" in x.split("Exchange ", 1)[1].split("]", 1)[0] and "REPARTITION" in x for x in exchanges(results)) == 1
    assert not any("query_id" in x.split("(", 1)[1].split("), ")[0] for x in exchanges(results) if "hashpartitioning(doc_id" in x)
    dwords = matching.doc_words(docs)
    best = matching.best_distances(dwords, spark.createDataFrame([("ring", "ring", 0, 0)], "doc_word string, query_word string, hamming int, edit int"))
    assert sum("hashpartitioning(doc_id" in x for x in exchanges(best)) == 1


def test_queries_with_a_word_that_nothing_matches_are_dropped_before_documents(spark):
    wanted = spark.createDataFrame([("ring", 1, 0, 2), ("rang", 1, 1, 2), ("ring", 2, 0, 2), ("ring", 3, 2, 3), ("gold", 3, 0, 3), ("iron", 4, 0, 1)], "doc_word string, query_id long, pos int, n_words int")
    assert sorted({r.query_id for r in matching.answerable(wanted).collect()}) == [1, 4]


@settings(max_examples=3, deadline=None)
@given(st.sets(st.text("abz", min_size=4, max_size=31), min_size=1, max_size=25), st.integers(1, 3))
def test_hamming_by_keys_and_by_length_agree(spark, some, k):
    more = some | {w[:-1] + "q" for w in some} | {"q" + w[1:] for w in some}
    v, q = (spark.createDataFrame([(x,) for x in s], "word string") for s in (more, some))
    want = {(x, y, d) for x in more for y in some if len(x) == len(y) and (d := sum(a != b for a, b in zip(x, y, strict=True))) <= k}
    for band in (None, 0, 2):
        assert {tuple(r) for r in wordjoin.hamming_word_join(v, q, k, band).collect()} == want
