import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textweir.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, part long, copies string"


def docs_of(spark, sizes, extra=()):
    """Documents of so many words by source; the other columns only clash in name."""
    rows = [(k, " ".join(["w"] * n), s, "x", 1, "y") for k, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    return spark.createDataFrame([*rows, *((i, t, s, "x", 1, "y") for i, t, s in extra)], SCHEMA)


def targets_of(sizes):
    """As the contract says it: what is above a source's end is shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    own = {s: sum(sizes[s]) for s in names}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(own.values()))
    while open_ and left > 1e-9:
        whole = sum(weight[s] for s in open_)
        share = {s: target[s] + left * weight[s] / whole for s in open_}
        left = sum(max(0.0, share[s] - 3 * own[s]) for s in open_)
        for s, x in share.items():
            target[s] = min(x, 3.0 * own[s])
        open_ -= {s for s in open_ if target[s] >= 3 * own[s]}
    return target


SIZES = {
    "b": [1, 1, 2, 3, 5, 8, 400, 90] * 6, "a": [7] * 50, "Z": [100, 3], "": [9, 9, 4], "é": [1000] + [10] * 40, "\U0001f642": [2], "～": [0, 0], None: [30] * 20 + [1] * 9}


@pytest.fixture(scope="module")
def mixed(spark):
    return mixing.mix(docs_of(spark, SIZES, [(900, None, "b"), (901, " \t\r\n", "a"), (None, "two words", "Z"), (902, "w w x", "a"), (902, "w w x", "a")])).collect()


def test_targets_and_sizes(mixed):
    sizes = {s: list(n) for s, n in SIZES.items()}
    sizes["b"].append(0)
    sizes["a"] += [0, 2, 2]
    sizes["Z"].append(2)
    want = targets_of(sizes)
    assert len(mixed) == sum(map(len, sizes.values()))
    for r in mixed:
        assert r.target == pytest.approx(want[r.source], rel=1e-12, abs=1e-9) and r.source_size == sum(sizes[r.source])
    assert any(want[s] == 3 * sum(sizes[s]) > 0 for s in want) and sum(want.values()) == pytest.approx(sum(map(sum, sizes.values())))


def test_rates_solve_the_dual_and_copies_round_them(mixed):
    by = defaultdict(list)
    for r in mixed:
        by[r.source].append(r)
    for rows in by.values():
        full = [r for r in rows if r.size]
        target = rows[0].target
        assert sum(r.rate * r.size for r in full) == pytest.approx(target, rel=1e-6)
        # Rates below the bound are exp(l * size): one l for the source.
        tilts = [math.log(r.rate) / r.size for r in full if 0 < r.rate < 2.999999]
        assert not tilts or max(tilts) - min(tilts) < 1e-6
        assert all(0 <= r.copies <= 3 for r in rows) and all(r.copies == 0 for r in rows if not r.size)
        spare = [r.size for r in full if 0 < r.copies < 3] or [max((r.size for r in full), default=0)]
        assert abs(sum(r.copies * r.size for r in full) - target) <= max(min(spare), 1)


def test_reruns_agree_however_the_rows_are_split(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    once = sorted(map(tuple, mixing.op11_entropy_balancing(spark, d).collect()))
    monkeypatch.setattr(mixing, "table", lambda s, *_: s.read.parquet(f"{d}/documents.parquet").repartition(7, "text"))
    assert sorted(map(tuple, mixing.op11_entropy_balancing(spark, d).collect())) == once and len(once) == 200


def test_hot_cell_is_dealt_in_parts(spark):
    """Copies of one text in one source: copies are spread over all of them, one more or less for each."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"))
    got = mixing.mix(docs).collect()
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.copies * r.size
    assert taken == {"a": 3000, "b": 6000} and {r.copies for r in got if r.source == "b"} == {2} and {r.copies for r in got if r.source == "a"} <= {0, 1, 2}


def test_copied_rows_and_empty_tables(spark, mixed):
    docs = docs_of(spark, {"a": [4, 4, 2, 1], "b": [3]}, [(0, "w w w w", "a"), (None, None, "b")])
    mixture = mixing.mix(docs)
    out = mixing.copied(docs, mixture).collect()
    assert sum(len((r.text or "").split()) for r in out) == sum(r.copies * r.size for r in mixture.collect()) > 0
    assert len({(r.doc_id, r.copy) for r in out}) == len(out) and out[0].part == 1
    empty = docs.where("false")
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs_of(spark, {"a": [0, 0], None: [0]})).where("copies <> 0 or target <> 0").count() == 0


def test_plan_has_no_python(spark):
    plan = mixing.op11_entropy_balancing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
