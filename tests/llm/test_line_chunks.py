"""Content-defined chunks of lines: boundaries and removal, against brute force."""

import random

from textweir.llm import linededup
from textweir.llm.shared import Pieces, runs

SCHEMA = "doc_id long, text string, row string, one string, at string"


def deduped(spark, rows):
    return {r.row.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame([(i, t, "r", "o", "a") for i, t in rows], SCHEMA).repartition(3)).collect()}


def plain_boundaries(text):
    """Pair by pair, by the definition."""
    lines = text.split("\n")
    value = [int(runs(Pieces([f"{a}\n{b}".encode()], b"\n", empty=True).hashes, 2)[0]) if (a + b).strip() else None for a, b in zip(lines, lines[1:])]
    out = []
    for k, v in enumerate(value):
        ends = k == 0 or k == len(value) - 1
        beside = [value[j] for j in (k - 1, k + 1) if 0 <= j < len(value)]
        if v is not None and (ends or any(x is None or v <= x for x in beside)):
            out.append(k)
    return out


def plain(rows):
    """Of each document the lines that go: chunks that are chunks earlier too, and three lines that stand earlier."""
    pairs, triples, out = {}, {}, {}
    for i, t in sorted(rows):
        own, gone = (t or "").split("\n"), set()
        for k in plain_boundaries(t or ""):
            d, j = pairs.setdefault(tuple(own[k : k + 2]), (i, k))
            gone |= {k, k + 1} if d < i or j + 2 <= k else set()
        for k in range(len(own) - 2):
            if any(x.strip() for x in own[k : k + 3]):
                d, j = triples.setdefault(tuple(own[k : k + 3]), (i, k))
                gone |= {k, k + 1, k + 2} if d < i or j + 3 <= k else set()
        marked = [k for k, x in enumerate(own) if x.strip() or k in gone]
        for x, y in zip(marked, marked[1:]):
            gone |= set(range(x, y)) if {x, y} <= gone else set()
        out[i] = gone
    return out


def test_boundaries_by_definition_and_under_edits():
    rng = random.Random(31)
    for _ in range(300):
        lines = [rng.choice(["", " ", *map(str, range(40))]) for _ in range(rng.randrange(1, 30))]
        assert linededup.boundaries("\n".join(lines)) == plain_boundaries("\n".join(lines))
    lines = [f"line {k}" for k in range(400)]
    before = linededup.boundaries("\n".join(lines))
    assert max(b - a for a, b in zip(before, before[1:])) == 2 and len(before) < 0.75 * len(lines)
    for k in (1, 57, 200, 398):
        after = linededup.boundaries("\n".join([*lines[:k], "new", *lines[k:]]))
        assert {x for x in before if x < k - 2} == {x for x in after if x < k - 2}
        assert {x + 1 for x in before if x > k} == {x for x in after if x > k + 1}


def test_random_lines_against_brute_force(spark):
    rng = random.Random(32)
    for kinds in (9, 14, 30):
        rows = [(i, "\n".join(rng.choice(["", " ", *map(str, range(kinds))]) for _ in range(rng.randrange(14)))) for i in range(90)]
        rows += [(90, None), (91, ""), (92, "\n\n\n"), (93, "x\nx\nx\nx\nx"), (94, "é\n\n\n\nö"), (95, "a\né\n\n\n\nö"), (96, "a\né"), (97, "z\n" * 9)]
        got, gone = deduped(spark, rows), plain(rows)
        assert sum(map(len, gone.values())) > 50
        for i, t in rows:
            own = (t or "").split("\n")
            assert (got[i].text or "") == "\n".join(x for k, x in enumerate(own) if k not in gone[i]), i
            assert (got[i].n_lines, got[i].n_removed) == (len(own) if t else 0, len(gone[i]))


def test_runs_of_three_lines_and_more_go_in_any_context(spark):
    rng = random.Random(33)
    new = iter(range(10**6))
    lines = lambda n: [f"own {next(new)} " + " ".join(f"w{rng.randrange(400)}" for _ in range(8)) for _ in range(n)]
    passages = [lines(n) for n in (3, 4, 5, 6, 20) for _ in range(30)]
    rows, want = [], {}
    for p, passage in enumerate(passages):
        for k in range(3):
            before, after = lines(rng.randrange(4)), lines(rng.randrange(4))
            i = 1000 * k + p
            rows.append((i, "\n".join([*before, *passage, *after])))
            want[i] = rows[-1][1] if k == 0 else "\n".join([*before, *after])
    rng.shuffle(rows)
    got = deduped(spark, rows)
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.row.one == "o" and r.row.at == "a" for r in got.values())


def test_repeated_rows_null_ids_long_texts_and_no_rows(spark):
    long = "\n".join(f"line {k}" for k in range(60_000))
    got = linededup.dedup_lines(spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "d"), (None, "a\nb\nc"), (2, long), (3, "head\n" + long), (4, "y" * 3_000_000 + "\nz"), (5, "y" * 3_000_000 + "\nz")], "doc_id long, text string")).collect()
    assert sorted((r.row.doc_id or 0, r.text) for r in got if r.row.doc_id in (None, 1, 3, 5)) == [(0, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (1, "d"), (3, "head"), (5, "")]
    assert linededup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
