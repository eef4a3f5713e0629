"""Each stage of the pipeline on planted documents, against a plain Python version on the same input."""

import random
import re

import corpus_pipeline
from textweir.llm.packing import default_tokenizer


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.lower())


def _toxic_free(docs):
    return {i: t for i, t in docs.items() if "scum" not in _words(t)}


def _lines(docs):
    first, out = {}, {}
    for i in sorted(docs):
        own, gone = docs[i].split("\n"), set()
        for k, pair in enumerate(zip(own, own[1:])):
            d, j = first.setdefault(pair, (i, k))
            gone |= {k, k + 1} if d < i or j + 2 <= k else set()
        out[i] = "\n".join(x for k, x in enumerate(own) if k not in gone)
    return out


def _near(docs):
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, t in docs.items() for w in [_words(t)]}
    of = {i: i for i in docs}
    for i in sorted(docs):
        for j in sorted(docs):
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((of[i], of[j]))
                of = {k: a if v == b else v for k, v in of.items()}
    return {i: t for i, t in docs.items() if of[i] == i}


def _clean(docs, items):
    windows = {tuple(w[j : j + 10]) for t in items for w in [_words(t)] for j in range(len(w) - 9)}
    return {i: t for i, t in docs.items() if not windows & {tuple(w[j : j + 10]) for w in [_words(t)] for j in range(len(w) - 9)}}


def test_each_stage_on_planted_documents(spark, tmp_path):
    rng = random.Random(21)
    line = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(12))
    docs = {i: "\n".join(line() for _ in range(rng.randrange(3, 8))) for i in range(200)}
    items = ["\n".join(line() for _ in range(2)) for _ in range(4)]
    toxic, repeated, near, leaked = range(0, 200, 4), range(1, 60, 4), range(61, 110, 4), range(111, 160, 4)
    passage = [line(), line()]
    for i in toxic:
        docs[i] += "\nscum vile scum"
    for i in repeated:
        docs[i] = "\n".join([line(), *passage, line()])
    for i in near:
        own = re.split(" ", docs[i - 2])
        docs[i] = " ".join([*own[:-1], "other"]).replace("\n", " ")
    for k, i in enumerate(leaked):
        docs[i] += " " + items[k % 4].replace("\n", " ")
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in docs], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    plain = {"toxicity": _toxic_free, "line_dedup": _lines, "near_dedup": _near, "decontamination": lambda x: _clean(x, items)}
    now = spark.read.parquet(f"{sf}/documents.parquet")
    schema, given = now.schema, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, now, sf).collect()
        want = plain[name](given)
        assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want), name
        assert want != given and all(r.n_chars == len(r.text) for r in rows), name
        given, now = want, spark.createDataFrame(rows, schema)
    assert not set(toxic) & set(given) and not set(leaked) & set(given) and not set(near) & set(given)

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    for i, t in given.items():
        own = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)
        ids = [int.from_bytes(b[k : k + 4], "little") for b in [b"".join(r.tokens for r in own)] for k in range(0, len(b), 4)]
        assert ids == [*tok.encode(t, add_special_tokens=False).ids, 1]
    assert {r.doc_id for r in pieces} == set(given)
