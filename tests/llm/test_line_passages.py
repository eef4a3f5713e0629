"""Repeated passages of a few lines, against brute force."""

import random

from textweir.llm import linededup

SCHEMA = "doc_id long, text string, row string"


def deduped(spark, rows):
    return {r.row.doc_id: r for r in linededup.dedup_passages(spark.createDataFrame([(i, t, "r") for i, t in rows], SCHEMA)).collect()}


def test_passages_of_two_to_six_lines_in_other_contexts(spark):
    rng = random.Random(11)
    new = iter(range(10**6))
    lines = lambda n: [f"own {next(new)} " + " ".join(f"w{rng.randrange(400)}" for _ in range(8)) for _ in range(n)]
    passages = [lines(n) for n in (2, 3, 4, 5, 6) for _ in range(6)]
    rows, want = [], {}
    for p, passage in enumerate(passages):
        for k in range(3):
            before, after = lines(rng.randrange(4)), lines(rng.randrange(4))
            i = 100 * k + p
            rows.append((i, "\n".join([*before, *passage, *after])))
            want[i] = rows[-1][1] if k == 0 else "\n".join([*before, *after])
    rng.shuffle(rows)
    got = deduped(spark, rows)
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_removed == (len(passages[i % 100]) if i >= 100 else 0) for i, r in got.items())


def test_random_lines_against_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, "\n".join(rng.choice(["", " ", *map(str, range(14))]) for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n\n"), (63, "x\nx\nx\nx\nx"), (64, "é\n\n\n\nö"), (65, "a\né\n\n\n\nö"), (66, "a\né")]
    got, first = deduped(spark, rows), {}
    assert sum(r.n_removed for r in got.values()) > 100
    for i, t in rows:
        own = (t or "").split("\n")
        gone = set()
        for k, pair in enumerate(zip(own, own[1:])):
            if any(x.strip() for x in pair):
                d, j = first.setdefault(pair, (i, k))
                gone |= {k, k + 1} if d < i or j + 2 <= k else set()
        for k, x in enumerate(own):
            left = next((j for j in range(k, -1, -1) if own[j].strip() or j in gone), None)
            right = next((j for j in range(k, len(own)) if own[j].strip() or j in gone), None)
            gone |= {k} if not x.strip() and {left, right} <= gone else set()
        assert (got[i].text or "") == "\n".join(x for k, x in enumerate(own) if k not in gone)
        assert (got[i].n_lines, got[i].n_removed) == (len(own) if t else 0, len(gone))
    twins = deduped(spark, [(1, "a\nb"), (1, "a\nb"), (None, "a\nb")])
    assert twins[1].text == twins[None].text == "a\nb"
    thin = {r.row.doc_id: r for r in linededup.dedup_passages(spark.createDataFrame([(i, t, "r") for i, t in rows], SCHEMA), 3).collect()}
    assert 0 < sum(r.n_removed for r in thin.values()) < sum(r.n_removed for r in got.values()) and all(thin[i].n_removed <= got[i].n_removed for i in got)
    assert linededup.dedup_passages(spark.createDataFrame([], SCHEMA)).count() == linededup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
