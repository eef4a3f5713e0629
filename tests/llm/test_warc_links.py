"""Captures of any links against a plain union of sets, and damaged archives."""

import gzip
import random

import pytest

from textweir.llm import warc


def plain_captures(links):
    """Sets of ids that links tie, links being {id: ids}."""
    of = {x: {x} for i, to in links.items() for x in (i, *to)}
    for i, to in links.items():
        for x in to:
            if of[i] is not of[x]:
                both = of[i] | of[x]
                for y in both:
                    of[y] = both
    return {frozenset(s & set(links)) for s in of.values()} - {frozenset()}


def captures(spark, links):
    rows = spark.createDataFrame([(i, list(to)) for i, to in links.items()], "record_id string, concurrent_to array<string>")
    out = {}
    for r in warc._captures(rows).collect():
        out.setdefault(r.capture, set()).add(r.record_id)
    return {frozenset(s) for s in out.values()}


def test_captures_of_stars_chains_and_loops(spark):
    stars = {f"{kind}{k}": [] if kind == "r" else [f"r{k}"] for k in range(20) for kind in "rqm"}
    assert captures(spark, stars) == plain_captures(stars)
    knotted = stars | {"q1": ["r1", "r2"], "m3": ["q3"], "r4": ["r4"], "r5": ["q5"], "r6": ["r7"], "q8": ["gone"], "m8": ["gone"], "m9": ["r9", "r9"]}
    assert captures(spark, knotted) == plain_captures(knotted)
    rng = random.Random(41)
    for n in (12, 60):
        links = {f"x{k}": [f"x{rng.randrange(n)}" for _ in range(rng.choice([0, 0, 1, 1, 2]))] for k in range(n)}
        assert captures(spark, links) == plain_captures(links)


def test_damaged_archives_end_the_job_or_are_kept_by_name(spark, tmp_path):
    def record(name, block, length=True):
        lines = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:page:response:{name}>", *([f"Content-Length: {len(block)}"] * length)]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    body = b"HTTP/1.1 200 OK\r\n\r\n"
    sound = [record(k, body + bytes(random.Random(k).randbytes(3000))) for k in range(4)]
    whole = gzip.compress(b"".join(sound[:2]))
    (tmp_path / "a.gz").write_bytes(whole)
    read = lambda **more: warc.read_archives(spark, f"file://{tmp_path}", **more)
    assert read().count() == 2
    (tmp_path / "b.gz").write_bytes(gzip.compress(sound[2]) + gzip.compress(sound[3])[:-1500])
    (tmp_path / "c.gz").write_bytes(gzip.compress(record(5, body, length=False)))
    (tmp_path / "d.gz").write_bytes(b"no gzip")
    (tmp_path / "e.gz").write_bytes(gzip.compress(record(6, body)[:-12]))
    (tmp_path / "f.gz").write_bytes(b"")
    with pytest.raises(Exception, match="[bcde].gz"):
        read().count()
    rows = read(keep_damaged=True).collect()
    assert sorted(r.record_id for r in rows if r.type == "response") == [f"<urn:page:response:{k}>" for k in range(3)]
    assert sorted(r.target[-4:] for r in rows if r.type == "damaged") == ["b.gz", "c.gz", "d.gz", "e.gz"]
    assert sorted(r.page_id for r in warc.assemble(read(keep_damaged=True)).collect()) == [0, 1, 2]
