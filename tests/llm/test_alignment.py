import random

import public_tokenizers
from pyspark.sql import functions as F

from textweir.llm import alignment

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = ["a", "b", " ", "  ", "\n", "\t", "é", "é", " ", "▁", "　", "日本", "\U0001f642", "'s", "12", ".", "<|endoftext|>", "</s>", "\x1c", "\x85", "the", "\x00", " ", "ﬁ"]


def tokens(text):
    """The ids and bytes of the tokens of both sides by the tokenizers' own words; None if they do not give back the text."""
    if not text:
        return None
    a = aligner().a.encode(" " + text, add_special_tokens=False).ids
    b = aligner().b.encode(text)
    of_a, of_b = [aligner().bytes_a[i] for i in a], [aligner().bytes_b[i] for i in b]
    given = f" {text}".encode()
    return (a, of_a, b, of_b) if b"".join(of_a) == given == b"".join(of_b) else None


def aligner():
    return alignment._aligner(A, B)


def brute(text):
    """n_a, n_b, groups and links, token by token."""
    if not (found := tokens(text)):
        return 0, 0, "", []
    a, of_a, b, of_b = found
    groups, links, i, j, x, y, k, m = [], [], 0, 0, 0, 0, 0, 0
    while i < len(a):
        x, i = x + len(of_a[i]), i + 1
        while y < x:
            y, j = y + len(of_b[j]), j + 1
        if x == y:
            groups.append(",".join(map(str, a[k:i])) + "|" + ",".join(map(str, b[m:j])))
            links.append((a[i - 1], b[j - 1]))
            k, m = i, j
    return len(a), len(b), ";".join(groups), links


def test_token_bytes_are_the_vocabularies_own():
    assert alignment.found_path(A) == public_tokenizers.path(A) and alignment.found_path(__file__) == __file__
    assert aligner().units
    for i in (0, 220, 262, 1000, 49_000):
        assert aligner().bytes_a[i].decode("utf-8", "replace") == aligner().a.decode([i])


def test_units_align_as_whole_texts():
    random.seed(4)
    texts = ["".join(random.choice(ODD) for _ in range(random.randint(0, 14))) for _ in range(3000)] + [None, "", "x" * 3000, "many words " * 500]
    n_a, n_b, links, bounds, groups = aligner()(texts)
    for k, text in enumerate(texts):
        got = n_a[k], n_b[k], groups[k].decode(), [(x >> 32, x & 0xFFFFFFFF) for x in links[bounds[k] : bounds[k + 1]].tolist()]
        assert got == brute(text), text
    whole = alignment.Aligner(public_tokenizers.path(A), public_tokenizers.path(B))
    whole.units = False
    assert whole(texts)[4] == groups


def test_known_units_are_forgotten_in_between(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_BYTES", 50)
    own = alignment.Aligner(public_tokenizers.path(A), public_tokenizers.path(B))
    for text in ("the first few words of all", "some more of the words", "the first ▁ words"):
        assert own([text, text])[4] == [brute(text)[2].encode()] * 2


def test_counts_over_all_texts(spark, monkeypatch):
    rows = [(1, "The cat sat. The cat's hat."), (1, "The cat sat. The cat's hat."), (2, "the hat of the cat"), (3, None), (4, ""), (5, "a▁b"), (None, "cat hat sat"), (6, "co-operate reoperate operators")]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, links long, row_id string")
    counts = {}
    for _, t in rows:
        for pair in brute(t)[3]:
            counts[pair] = counts.get(pair, 0) + 1
    most = {b: max(n for (_, y), n in counts.items() if y == b) for _, b in counts}
    want = []
    for i, t in rows:
        n_a, n_b, groups, links = brute(t)
        want.append((i, n_a, n_b, groups, len(links), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links)))
    for bound in (alignment.BROADCAST_PAIRS, 0):
        monkeypatch.setattr(alignment, "BROADCAST_PAIRS", bound)
        got = alignment.scored(alignment.align(docs)).select("doc_id", "n_a", "n_b", "groups", "n_groups", "n_links", "n_best", "count_sum").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert alignment.scored(alignment.align(docs.where("false"))).count() == 0


def test_query_is_brute_force(spark, tmp_path):
    import hashlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in alignment.op13_cross_tokenizer_alignment(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", F.col("text")).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        n_a, n_b, groups, links = brute(t)
        assert (got[i].n_a, got[i].n_b, got[i].n_links) == (n_a, n_b, len(links))
        assert got[i].groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if n_a else "")


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text union all select 2L, 'a b'")
    assert {r.doc_id: r.n_a for r in alignment.align(docs).collect()} == {1: 0, 2: 2}
