"""One row per page: repeated and null ids, equal payloads among them, and archives bounded by bytes."""

from textweir.llm import warc


def test_repeated_and_null_ids_as_in_the_sql(spark, tmp_path):
    a, b, c = "a" * 1200, "b" * 1200, "c" * 1200
    pages = [(1, a), (1, a), (1, b), (2, b), (2, "x"), (2, "x"), (3, a), (4, c), (None, c), (None, c), (None, "d" * 1500), (None, "d" * 1500), (None, None), (-5, b)]
    spark.createDataFrame([(i, f"u{k}", h) for k, (i, h) in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op8_warc_transactions(spark, str(tmp_path)).collect()
    assert len(got) == len(pages) and all(r.has_request and r.has_metadata for r in got)
    top = {h: max((i for i, x in pages if x == h and i is not None), default=None) for h in (a, b, c)}
    want = []
    for i, h in pages:
        o = top.get(h)
        want.append((i, len(h or ""), "response" if o is None or o == i else "revisit", o if None not in (o, i) and o != i else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)


def test_record_ids_are_unique_and_referred_ones_exist(spark, tmp_path):
    h = "h" * 2000
    df = spark.createDataFrame([(7, "u", h), (7, "u", h), (7, "v", "other"), (3, "u", h), (None, "u", h), (None, "u", h)], "page_id long, url string, html string")
    rows = warc.read_archives(spark, warc.write_archives(df, f"file://{tmp_path}/w", null_ids=True)).collect()
    assert len(rows) == 18 == len({r.record_id for r in rows})
    refers = [r.refers_to for r in rows if r.refers_to]
    assert len(refers) == 1 and {*refers} <= {r.record_id for r in rows if r.type == "response" and r.payload == h.encode()}


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SMALL_BYTES", 100)
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 300)
    sizes = [50] * 120 + [700] * 60 + [6000] * 10 + [300_000] * 3
    df = spark.createDataFrame([(k, "u", chr(97 + k % 26) * n) for k, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(df, f"file://{tmp_path}/w")
    found = [list(warc.parse(f.read_bytes())) for f in (tmp_path / "w").glob("*.gz")]
    assert sorted(n for f in found for r in f if (n := r[5]) is not None) == sorted(sizes)
    for f in found:
        pages = [r[5] for r in f if r[1] in ("response", "revisit")]
        assert sum(pages) <= 100 * 100 or len(pages) == 1
    assert warc.assemble(warc.read_archives(spark, path)).count() == len(sizes)


def test_archive_of_another_writer(spark, tmp_path):
    """A gzip member for each record, links in both directions and several in one record, no space behind a colon, base 32."""
    import base64
    import gzip
    import hashlib

    def record(kind, name, block, *more):
        lines = ["WARC/1.0", f"WARC-Type:{kind}", f"warc-record-id: <{name}>", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"]
        return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    to = lambda *names: [f"WARC-Concurrent-To: <{n}>" for n in names]
    body = b"HTTP/1.1 200 OK\r\n\r\n"
    digest = base64.b32encode(hashlib.sha1(b"old").digest()).decode()
    parts = [
        record("warcinfo", "w", b"software: x\r\n"),
        record("response", "r1", body + b"one\r\n\r\nWARC/1.0", *to("q1")), record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", *to("r1", "m1")), record("metadata", "m1", b"a: b\r\n"),
        record("request", "q2", b"GET / HTTP/1.1\r\n\r\n"), record("revisit", "v2", body, *to("q2", "m2"), f"WARC-Payload-Digest: sha1:{digest}"), record("metadata", "m2", b""),
        record("response", "r3", body + b"three")]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(parts))
    rows = warc.read_archives(spark, f"file://{tmp_path}")
    found = {r.response.record_id: r for r in warc.assemble(rows).collect() if r.response}
    ids = {k: (r.request and r.request.record_id, r.metadata and r.metadata.record_id) for k, r in found.items()}
    assert ids == {"<r1>": ("<q1>", "<m1>"), "<v2>": ("<q2>", "<m2>"), "<r3>": (None, None)}
    assert found["<r1>"].response.payload == b"one\r\n\r\nWARC/1.0" and found["<v2>"].response.payload_digest == hashlib.sha1(b"old").hexdigest()
    assert found["<v2>"].response.payload_bytes is None and found["<r3>"].page_id is None


def test_empty_table_clashing_names_and_mandatory_fields(spark, tmp_path):
    schema = "page_id long, url string, html string, digest string, owner long, value string"
    empty = spark.createDataFrame([], schema)
    assert warc.assemble(warc.read_archives(spark, warc.write_archives(empty, f"file://{tmp_path}/e"))).count() == 0
    pages = spark.createDataFrame([(1, "u", "h" * 1500, "d", 7, "v"), (2, "u", "h" * 1500, "d", 7, "v")], schema)
    lines = [r.value for r in warc.records(pages, date="2024-05-06T07:08:09Z").collect()]
    assert len(lines) == 6 and all("\r\nWARC-Date: 2024-05-06T07:08:09Z\r\nContent-Type: application/" in x for x in lines)
