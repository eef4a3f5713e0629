"""Pairs just over and just under the threshold, alone with each other: found and left."""

import random

from textweir.llm import minhash


def test_pairs_at_the_threshold(spark):
    rng = random.Random(51)
    rows, near = [], set()
    for k in range(2000):
        shingles = rng.randrange(7, 300)
        most = shingles // 7  # changed last words: (shingles - changed) / (shingles + changed) >= 0.75
        changed = most + k % 2
        own = [f"w{rng.getrandbits(60)}" for _ in range(shingles + 4)]
        other = own[: len(own) - changed] + [f"w{rng.getrandbits(60)}" for _ in range(changed)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
        near |= {2 * k + 1} if changed == most else set()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if not r.kept} == near
