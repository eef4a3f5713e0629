"""Registry, delivery and log replay over several micro-batches, with retries and repeated documents."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from test_matching import BAD, LOG, lines, parsed, results_of
from textweir.jobs import queries
from textweir.jobs.replay import replay_folder, replay_log
from textweir.jobs.replay import replayed as replayed_results
from textweir.operators import lifecycle
from textweir.operators.verify import verify_results
from textweir.sources import commands as cmd
from textweir.sources.tables import batches, shared_dir
from textweir.streaming import streams


def state(spark, path):
    return sorted(tuple(r) for r in streams.registry(spark, path).collect())


def replayed(spark, path, parsed_rows, cuts):
    """Runs the stream over the commands cut at these places, each part after the last one was through."""
    p = lambda n: str(path / n)
    at = 0
    for i, c in enumerate(cuts):
        parsed_rows.where((F.col("seq") > at) & (F.col("seq") <= c)).coalesce(1).write.parquet(p(f"in/{i}"))
        at = c
        stream = spark.readStream.schema(parsed_rows.schema).option("recursiveFileLookup", "true").parquet(p("in"))
        streams.replay_stream(stream, p("state"), p("out"), p("cp")).awaitTermination()
    return p("state"), p("out")


def test_registry_over_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "REBUILT", 2)
    commands = parsed(spark, ["s 1 0 0 1 ring", "s 2 0 0 1 gold", "e 1", "e 7", "s 1 0 0 1 again", "s 3 0 0 1 iron", "s 7 0 0 1 lead", "e 2", "e 1", "s 2 0 0 1 gold", "x 9", "e 2", "s 9 2 4 1 tin"])
    path, _ = replayed(spark, tmp_path, commands, [4, 8, 10, 11, 13])
    # An end before the start is none, an id in use or once used is not given again.
    assert state(spark, path) == [(1, "ring", 0, 0, 1, 3), (2, "gold", 0, 0, 2, 8), (3, "iron", 0, 0, 6, None), (7, "lead", 0, 0, 7, None)]
    assert sorted((r.seq, r.reason) for r in streams.refused(spark, path).collect()) == [(5, "id used before"), (10, "id used before"), (11, "unknown command"), (13, "distance")]
    last = batches(spark, f"{path}/changes")[-1]
    # A micro-batch writes what it changed and no more; the table of open queries holds these only.
    rows = [spark.read.parquet(f"{path}/changes/batch={k}").count() for k in batches(spark, f"{path}/changes")]
    assert [n for n in rows if n] == [3, 3] and sum(rows) == 6
    assert len(batches(spark, f"{path}/open")) <= 2
    assert sorted(r.query_id for r in streams.open_queries(spark, path, last + 1).where("end_seq is null").collect()) == [3, 7]


def test_unsound_commands_on_a_stream_are_refused_as_in_a_batch(spark, tmp_path):
    rows = ["s 1 0 0 1 Ring", "s 1 0 0 1 ring", "s 2 2 4 1 golden", "m 1 2 ring silver", "m 2 1 Bad", "m 2 1 ring"]
    path, out = replayed(spark, tmp_path, parsed(spark, rows), [6])
    assert {r.doc_id: r.query_ids for r in streams.delivered(spark, out).collect()} == {1: [1], 2: [1]}
    assert sorted((r.seq, r.reason) for r in streams.refused(spark, path).collect()) == [(1, "characters"), (3, "distance"), (5, "characters")]


def test_retried_batch_writes_the_same_again(spark, tmp_path):
    judged = lambda rows: spark.createDataFrame(rows, streams.JUDGED)
    one = judged([(1, "s", 5, 0, 0, 1, "ring", None, None, None)])
    two = judged([(4, "e", 5, None, None, None, None, None, None, 1), (5, "s", 6, 0, 0, 1, "gold", None, None, None)])
    path = str(tmp_path / "state")
    streams.update_registry(one, 0, path)
    first = sorted(map(tuple, streams.update_registry(two, 1, path).collect()))
    assert sorted(map(tuple, streams.update_registry(two, 1, path).collect())) == first == state(spark, path) == [(5, "ring", 0, 0, 1, 4), (6, "gold", 0, 0, 5, None)]
    results = spark.createDataFrame([(1, 1, [5])], streams.RESULTS)
    for _ in range(2):
        streams.deliver_once(results, 3, str(tmp_path / "out"))
    assert [tuple(r) for r in streams.delivered(spark, str(tmp_path / "out")).collect()] == [(1, 1, [5], 3)]


@pytest.mark.parametrize("cuts", [[30], [1, 5, 9, 13, 18, 30]])
def test_checked_as_the_log_goes_on(spark, tmp_path, cuts):
    """Statuses of the stream are those of the batch; a change closes what came before it."""
    rows = [*LOG[:6], "r 1 2 1 2", "r 2 1 9", "m 30 1 ring", "r 31 0", *LOG[9:], *BAD, "m 50 1 ring"]
    p = parsed(spark, rows)
    path, _ = replayed(spark, tmp_path, p, [min(c, len(rows)) for c in cuts[:-1]] + [len(rows)])
    good, _ = cmd.validate_commands(p)
    docs, life, results = results_of(good)
    want = sorted((r.doc_id, r.status, r.missing_ids, r.extra_ids) for r in verify_results(results, cmd.parse_expected(good).drop("seq")).collect())
    assert sorted(map(tuple, streams.checked_results(spark, path).collect())) == want and {r[1] for r in want} == {"ok", "wrong", "missing", "unknown"}
    closed = spark.read.parquet(*(f"{path}/checked/batch={k}" for k in batches(spark, f"{path}/checked")))
    assert {r.doc_id for r in closed.collect()} == {r[0] for r in want} - {50}


def test_streams_leave_no_tables_behind(spark, tmp_path):
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    replayed(spark, tmp_path, parsed(spark), [22])
    assert set(shared.iterdir()) == before


def test_document_that_is_sent_again(spark, tmp_path):
    """Within a micro-batch the first by seq counts, over micro-batches the one of the first."""
    p = lambda n: str(tmp_path / n)
    q = results_of(parsed(spark))[1]
    schema = "doc_id long, seq long, text string"
    for rows in ([(1, 9, "nothing"), (1, 4, "silver rings ring")], [(1, 5, "goldens sliver"), (2, 6, "sliver goldens")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(p("in"))
        streams.match_stream(spark.readStream.schema(schema).parquet(p("in")), q, p("out"), p("cp")).awaitTermination()
    assert {r.doc_id: r.query_ids for r in streams.delivered(spark, p("out")).collect()} == {1: [1, 2], 2: [3]}


def test_log_file_to_verified_results(spark, tmp_path):
    (tmp_path / "log.txt").write_text("\n".join([*LOG, *BAD, "m 50 1 ring", "r 51 0"]) + "\n")
    got = {r.doc_id: r for r in replay_log(spark, str(tmp_path / "log.txt")).collect()}
    assert {i: r.status for i, r in got.items()} == {**{i: "ok" for i in range(1, 7)}, 50: "unknown", 51: "missing"}
    assert got[4].query_ids == [2, 4, 5] and got[6].query_ids == [] and got[51].num_res is None


def test_long_documents_are_checked_in_linear_time(spark):
    text = "abcdefgh " * 460_000  # 4.1 million characters
    rows = [f"m 1 1 {text}", f"m 2 1 {text}X", "m 3 1 " + "a" * 5_000_000, *(f"m x{i} 1 ring" for i in range(50))]
    began = time.time()
    got = {r.seq: r.reason for r in cmd.with_reasons(cmd.parse_commands(lines(spark, rows))).select("seq", "reason").collect()}
    assert got[1] is None and got[2] == "characters" and got[3] == "too long" and len(got) == 53 and time.time() - began < 60


def test_active_sets_on_a_sparse_clock(spark):
    q = spark.createDataFrame([(i, i * 10**9, None if i % 3 == 0 else i * 10**9 + 5 * 10**9) for i in range(100)], "query_id long, start_seq long, end_seq long")
    d = spark.createDataFrame([(i, i * 10**9 + 1) for i in range(0, 200, 7)] + [(999, 10**9)], "doc_id long, seq long")
    got = {(r.doc_id, r.query_id) for r in lifecycle.active_at_document(d, q).collect()}
    want = {(x.doc_id, y.query_id) for x in d.collect() for y in q.collect() if y.start_seq < x.seq and (y.end_seq is None or x.seq < y.end_seq)}
    assert got == want and len(want) > 500
    assert lifecycle.active_at_document(d.where("false"), q).count() == 0


def test_results_are_written_in_arrival_order(spark, tmp_path):
    rows = [(i, (i * 7919) % 1000, i % 3, list(range(i % 3))) for i in range(1000)] + [(5000, None, 0, [])]
    results = spark.createDataFrame(rows, "doc_id long, seq long, num_res int, query_ids array<long>").repartition(5)
    cmd.write_in_order(results, str(tmp_path / "lines"), 100)
    files = sorted((tmp_path / "lines").glob("part-*"))
    lines = [x for f in files for x in f.read_text().splitlines()]
    want = sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[0]))
    assert lines == [" ".join(map(str, ["r", r[0], r[2], *r[3]])) for r in want] and 5 <= len(files) <= 11
    cmd.write_in_order(results.where("false"), str(tmp_path / "lines"))
    assert not "".join(f.read_text() for f in (tmp_path / "lines").glob("part-*"))


def test_growing_folder_of_log_files_is_the_batch(spark, tmp_path):
    """File by file, with a blank line, CRLF ends and lines that are no commands, to the results, statuses and refusals of the whole log."""
    rows = [*LOG[:8], "", *BAD[:4], *LOG[8:], *BAD[4:], "m 50 1 ring"]
    folder, whole = tmp_path / "log", tmp_path / "whole"
    whole.mkdir()
    (whole / "log.txt").write_text("\n".join(rows) + "\n")
    cuts = [0, 4, 11, 11, 24, len(rows)]
    p = lambda n: str(tmp_path / n)
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        end = "\r\n" if k % 2 else "\n"
        name = folder / str(k // 2) / f"segment-{k:03}.txt"  # by folder, then by name
        name.parent.mkdir(parents=True, exist_ok=True)
        name.write_bytes("".join(r + end for r in rows[a:b]).encode())
        if k in (1, 4):
            replay_folder(spark, str(folder), p("state"), p("out"), p("cp")).awaitTermination()
    got = sorted(map(tuple, replayed_results(spark, p("state"), p("out")).collect()))
    assert got == sorted(map(tuple, replay_log(spark, str(whole)).collect())) and len(got) == 7
    _, bad = cmd.validate_commands(cmd.parse_commands(cmd.read_command_log(spark, str(whole))))
    assert sorted((r.cmd, r.id or -1, r.reason) for r in streams.refused(spark, p("state")).collect()) == sorted((r.cmd, r.id or -1, r.reason) for r in bad.collect())


def given_tables(spark, path):
    """documents, some without a legal word, and a benchmark whose queries are all open or start early."""
    texts = ["silver rings and golden things", "Von.", None, "", "golden things", "Ah! 12, oh.", "silver lining"]
    spark.createDataFrame(list(enumerate(texts, 30)), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    items = [(0, "silver golden rings"), (1, "golden things"), (2, "lining silver sliver")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_documents_without_a_legal_word_are_delivered_by_the_replay(spark, tmp_path):
    d = given_tables(spark, tmp_path)
    got = sorted(tuple(r) for r in queries.replay_stream(spark, d).collect())
    assert got == sorted(tuple(r) for r in queries.document_results(spark, d).collect())
    assert [r[0] for r in got] == list(range(30, 37)) and any(r[1] for r in got) and (31, 0, "") in got
    rows = ["m 1 0", "m 2", "m 3 2", "m 4 0 Bad", "m 1 1 ring"]
    reasons = lambda *x: [r[0] for r in parsed(spark, rows).orderBy("seq").select(cmd.unsound(*x)).collect()]
    assert reasons(True) == [None, "too few fields", "too few fields", "characters", None] and reasons()[0] == "too few fields"


def test_replayed_log_finds_what_its_lines_lack(spark, tmp_path):
    """Against lines of all results every document is right, against those of the exact queries the ids of the others are extra."""
    d = given_tables(spark, tmp_path)
    got = {r.doc_id: r for r in queries.replay_log(spark, d).collect()}
    exact = {r.doc_id: r.query_ids for r in queries._results(spark, d)[1].join(queries.match_exact(spark, d).groupBy("doc_id").agg(F.collect_set("query_id").alias("same")), "doc_id", "left").select("doc_id", F.array_except("query_ids", F.coalesce("same", F.array().cast("array<bigint>"))).alias("query_ids")).collect()}
    assert len(got) == 7 and {got[i].status for i in (31, 32, 33, 35)} == {"missing"}
    for i in (30, 34, 36):
        assert (got[i].status, got[i].missing_ids, got[i].extra_ids, got[i].exact_missing_ids) == ("ok", "", "", "")
        assert (got[i].exact_status, got[i].exact_extra_ids) == ("wrong" if exact[i] else "ok", ",".join(map(str, exact[i])))
    assert "wrong" in {r.exact_status for r in got.values()}
