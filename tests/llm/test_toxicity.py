"""The field against all taggings, its gradient against differences, and its accuracy on held-out documents."""

import random
import re
import zlib

import numpy as np

from textweir.llm import toxicity

SCHEMA = "doc_id long, text string, row string, score double, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", 0.5, "s") for i, t in rows], SCHEMA)


def taggings(first, emit, trans):
    """All taggings with their weights."""
    n = len(emit)
    for code in range(1 << n):
        tags = [code >> i & 1 for i in range(n)]
        yield tags, np.exp(sum(emit[i] * tags[i] + (0 if first[i] else trans[tags[i - 1], tags[i]]) for i in range(n)))


def test_marginals_against_all_taggings(monkeypatch):
    rng = np.random.default_rng(2)
    emit, trans = rng.normal(size=9), rng.normal(size=(2, 2))
    trans[0, 0] = 0
    first = np.zeros(9, bool)
    first[[0, 4]] = True
    every = list(taggings(first, emit, trans))
    total = sum(w for _, w in every)
    p = sum(w * np.array(t) for t, w in every) / total
    joint = np.zeros((9, 2, 2))
    for t, w in every:
        for i in np.flatnonzero(~first):
            joint[i, t[i - 1], t[i]] += w / total
    for block, segment in ((512, 400), (2, 1), (3, 2)):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        monkeypatch.setattr(toxicity, "SEGMENT", segment)
        found, none, pairs = toxicity.marginals(first, emit, trans, fit=True)
        assert np.allclose(found, p) and np.allclose(pairs, joint) and np.allclose(toxicity.marginals(first, emit, trans), p)
        for a, b in ((0, 4), (4, 9)):
            alone = sum(w for _, w in taggings(first[a:b], emit[a:b], trans))
            assert np.isclose(none[a:b].sum(), -np.log(alone))


def test_gradient_against_differences():
    texts = [b"you scum and trash", b"a fine day for all of us", b"trash day", b"x"]
    batch = toxicity._batches(texts, np.array([1.0, 0, 0, 1]))[0]
    model = toxicity.Crf(bias=-1.0)
    model.weights = np.random.default_rng(3).normal(size=toxicity.BUCKETS)
    model.trans = np.array([[0, 0.3], [-0.2, 0.5]])
    _, token, pairs = toxicity._step(model, batch)
    eps = 1e-5
    for i in batch.f[2:5, 0]:
        model.weights[i] += eps
        up = toxicity._step(model, batch)[0]
        model.weights[i] -= 2 * eps
        down = toxicity._step(model, batch)[0]
        model.weights[i] += eps
        assert np.isclose((up - down) / (2 * eps), token[(batch.f == i).any(axis=1)].sum(), atol=1e-5)
    for x, y in ((0, 1), (1, 0), (1, 1)):
        model.trans[x, y] += eps
        up = toxicity._step(model, batch)[0]
        model.trans[x, y] -= 2 * eps
        down = toxicity._step(model, batch)[0]
        model.trans[x, y] += eps
        assert np.isclose((up - down) / (2 * eps), pairs[x, y], atol=1e-5)


def test_planted_words_offsets_and_odd_rows(spark):
    rng = random.Random(1)
    text = lambda i: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(80)) + f" é {rng.choice(['scum', 'vile'] if i % 4 == 0 else ['plain', 'good', 'fine'])}, end"
    rows = [(i, text(i)) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "  \n1 2"), (None, "é SCUM vile"), (3, "scum vile scum"), (4, rows[4][1]), (903, "wab " * 60_000 + "scum vile")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows)
    for x in out:
        bad = bool(re.search("scum|vile", (x.row.text or "").lower()))
        assert (x.score >= 0.5) == bad and x.row.spans == "s" and x.row.score == 0.5
        assert {x.row.text[s.start : s.end].lower() for s in x.spans} <= {"scum", "vile"} and bool(x.spans) == bad
    assert {x.score for x in out if x.doc_id in (900, 901, 902)} == {min(x.score for x in out)}
    assert len({x.score for x in out if x.doc_id == 4}) == 1
    again = toxicity.fit(docs, labels)
    assert (again.weights == model.weights).all() and (again.curve == model.curve).all()
    for d, k in ((docs, labels.where("false")), (docs.where("false"), labels), (docs, labels.where("toxic = 1"))):
        assert all(x.score < 0.01 for x in toxicity.score(docs, toxicity.fit(d, k)).collect())
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_sample_is_bounded_and_never_held_out(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 3000)
    docs = frame(spark, [(i, "x" * (10 * i)) for i in range(200)] + [(7, "short"), (None, "y")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels).collect()
    assert 1500 < sum(len(r.text) for r in rows) <= 3000 and len({r.doc_id for r in rows}) == len(rows)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 and r.toxic == r.doc_id % 2 for r in rows)


def test_held_out_accuracy(spark, tmp_path):
    """Precision and recall on documents that the model has not seen, on the given tables; a tenth of the labels is noise."""
    sf = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in toxicity.op3_crf_toxicity(spark, sf).collect()}
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in out.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(y, out[i].predicted) for i, y in labels.items() if i in out and out[i].held_out]
    both = sum(y and p for y, p in held)
    assert len(held) > 700 and both / sum(p for _, p in held) > 0.9 and both / sum(y for y, _ in held) > 0.85
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    words = [texts[i][int(a) : int(b)] for i, r in out.items() if r.spans for a, b in [s.split(":") for s in r.spans.split(",")]]
    assert len(words) > 500 and all(re.fullmatch(r"[^\W\d_]+", w) for w in words)
