"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals give document scores and offsets.

Each token has one of two tags. Labels are for whole documents, so they label tokens by half: all tokens of a document
labelled clean have tag 0, at least one of a document labelled toxic has tag 1. The field is fitted on the likelihood of just
that (with a share of wrong labels, see WRONG): the forward pass gives the probability that all tags are 0, the marginals the
gradient. A token's features are its word, the words beside it, and its first and last letters, hashed to BUCKETS weights;
there is no word list. The most toxic marginal and the expected number of toxic tokens, under a logistic curve fitted on
documents that the weights have not seen, make the score; tokens with a marginal of at least 0.5, and the most toxic token of a document with
a score of at least 0.5, are the offending spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweir.llm.shared import Pieces, constants, crc32_text, mixed, prepared, slices, table, texts_of

#: The training sample: documents of each label, and bytes of all together.
SAMPLE_TOXIC, SAMPLE_OTHER, SAMPLE_BYTES = 700, 2600, 8_000_000
#: Weights, tokens of a step, passes over the sample at most, and passes without a gain after which they end.
BUCKETS, BATCH_TOKENS, PASSES, PATIENCE = 1 << 19, 40_000, 30, 3
#: The share of wrong labels that the fit allows for, the penalty of weights, the rate of steps, the first weight of every token.
WRONG, PENALTY, RATE, START = 0.05, 1e-4, 0.1, -7.0
#: Every HELD-th document of the sample only tells when to end and fits the curve, whose weights have a penalty of their own.
HELD, CURVE_PENALTY = 4, 0.1
#: Tokens of a block of the forward and backward passes, and blocks that are in memory at once.
BLOCK, SEGMENT = 512, 400

_SEPARATORS = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Values of a token's features (word, word before, word after, first letters, last letters): what stands beside counts less.
VALUES = np.array([1, 0.3, 0.3, 1, 1], np.float32)


@dataclass
class Crf:
    """weights of the features and `bias` for tag 1; trans: 2 x 2; curve: of the score."""

    bias: float = START
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.array([-8.0, 0.0, 0.0]))

    def emissions(self, f: np.ndarray) -> np.ndarray:
        return self.bias + sum(self.weights[f[:, j]] * v for j, v in enumerate(VALUES)).astype(np.float64)

    def tag(self, words: Pieces) -> np.ndarray:
        """Of each word the probability of tag 1."""
        if not len(words.hashes):
            return np.empty(0)
        most = SEGMENT * BLOCK
        emit = np.concatenate([self.emissions(features(words, a, a + most)) for a in range(0, len(words.hashes), most)])
        return marginals(starts_of(words), emit, self.trans)


def features(words: Pieces, a: int = 0, b: int | None = None) -> np.ndarray:
    """Of the words from a to b the places of their features' weights, in the order of VALUES; four letters at each end."""
    h, first = words.hashes, starts_of(words)
    b = min(len(h), len(h) if b is None else b)
    i = np.arange(a, b)
    lanes = np.lib.stride_tricks.sliding_window_view(words.raw, 4)
    size = np.minimum(words.ends[a:b] - words.starts[a:b], 4)
    short = np.array([(1 << 8 * k) - 1 for k in range(5)], np.uint32)[size]
    head = lanes[words.starts[a:b]].view("<u4").reshape(-1) & short
    tail = lanes[words.ends[a:b] - size].view("<u4").reshape(-1) & short
    before = np.where(first[a:b], np.uint64(1), h[i - 1])
    after = np.where(np.append(first[1:], True)[a:b], np.uint64(2), h[(i + 1) % len(h)])
    out = np.empty((b - a, len(VALUES)), np.int32)
    for j, (x, c) in enumerate(zip((h[a:b], before, after, head.astype(np.uint64), tail.astype(np.uint64)), constants(len(VALUES), 61), strict=True)):
        out[:, j] = mixed(x + c) >> np.uint64(65 - BUCKETS.bit_length())
    return out


def starts_of(words: Pieces) -> np.ndarray:
    """Whether a token is the first of its text."""
    first = np.zeros(len(words.hashes), bool)
    first[words.first[:-1][np.diff(words.first) > 0]] = True
    return first


def _products(first: np.ndarray, emit: np.ndarray, trans: np.ndarray, n: int) -> np.ndarray:
    """2 x 2 x n: of each token the matrix from the tag before to its own, unit matrices behind the last; at a text's first
    token the tag before has no say."""
    m = np.empty((2, 2, n))
    m[:, :, len(emit) :] = np.eye(2)[:, :, None]
    e = np.exp(np.clip(emit, -50, 50))
    for x in range(2):
        for y in range(2):
            step = np.where(first, 1.0, np.exp(trans[x, y]))
            m[x, y, : len(emit)] = step * e if y else step
    return m


def _blocked(first: np.ndarray, emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """_products() as 2 x 2 x step x block."""
    blocks = -(-len(emit) // BLOCK)
    return np.ascontiguousarray(_products(first, emit, trans, blocks * BLOCK).reshape(2, 2, blocks, BLOCK).swapaxes(2, 3))


def _totals(m: np.ndarray) -> np.ndarray:
    """block x 2 x 2: each block's product, up to a factor."""
    a, b, c, d = np.ones(m.shape[3]), np.zeros(m.shape[3]), np.zeros(m.shape[3]), np.ones(m.shape[3])
    for i in range(BLOCK):
        w, x, y, z = m[0, 0, i], m[0, 1, i], m[1, 0, i], m[1, 1, i]
        a, b, c, d = a * w + b * y, a * x + b * z, c * w + d * y, c * x + d * z
        if i % 4 == 3 or i == BLOCK - 1:
            most = 1 / (a + b + c + d)
            a, b, c, d = a * most, b * most, c * most, d * most
    return np.stack([a, b, c, d], axis=1).reshape(-1, 2, 2)


def _passes(m: np.ndarray, ahead: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of each token of blocks, from what reaches each block from both sides: tag 1 over tag 0."""
    forth, aback = np.empty(m.shape[2:]), np.empty(m.shape[2:])
    r = ahead
    for i in range(BLOCK):
        r = forth[i] = (m[0, 1, i] + m[1, 1, i] * r) / (m[0, 0, i] + m[1, 0, i] * r)
    r = back
    for i in range(BLOCK - 1, -1, -1):
        aback[i] = r
        r = (m[1, 0, i] + m[1, 1, i] * r) / (m[0, 0, i] + m[0, 1, i] * r)
    return forth.T.reshape(-1), aback.T.reshape(-1)


def marginals(first: np.ndarray, emit: np.ndarray, trans: np.ndarray, fit: bool = False):
    """Each token's probability of tag 1.

    first: whether a token begins a text; emit: its score for tag 1. Blocks of tokens are multiplied side by side, SEGMENT
    blocks at once, then the blocks one after another, so the passes are exact at any length. With fit also: the log
    probability of tag 0 given tag 0 before (whose sum over a text is that of no tag 1), and of each token the 2 x 2
    probabilities of the tags before and of itself (zero at a text's first).
    """
    n = len(emit)
    parts = [slice(a, min(n, a + SEGMENT * BLOCK)) for a in range(0, n, SEGMENT * BLOCK)]
    only = _blocked(first, emit, trans) if len(parts) == 1 else None
    of = lambda s: only if only is not None else _blocked(first[s], emit[s], trans)
    total = np.concatenate([_totals(of(s)) for s in parts]).tolist()
    ahead, back = np.empty(len(total)), np.empty(len(total))
    r = 1.0
    for k, ((a, b), (c, d)) in enumerate(total):
        ahead[k] = r
        r = (b + d * r) / (a + c * r)
    r = 1.0
    for k in range(len(total) - 1, -1, -1):
        (a, b), (c, d) = total[k]
        back[k] = r
        r = (c + d * r) / (a + b * r)
    p, none, joint = np.empty(n), np.empty(n if fit else 0), np.empty((n if fit else 0, 2, 2))
    for k, s in enumerate(parts):
        m = of(s)
        at, size = slice(k * SEGMENT, k * SEGMENT + m.shape[3]), s.stop - s.start
        alpha, beta = (x[:size] for x in _passes(m, ahead[at], back[at]))
        both = alpha * beta
        p[s] = both / (1 + both)
        if fit:
            m = _products(first[s], emit[s], trans, size)
            none[s] = np.log(m[0, 0] / (m[0, 0] + m[0, 1] * beta))
            before = np.concatenate([ahead[at][:1], alpha[:-1]])
            for x in range(2):
                for y in range(2):
                    joint[s, x, y] = np.where(first[s], 0.0, (before if x else 1.0) * m[x, y] * (beta if y else 1.0))
    if not fit:
        return p
    joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
    return p, none, joint


def _signals(p: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of each text: the log odds of its most toxic token, and the log of the expected toxic tokens."""
    out = np.tile([-12.0, -12.0], (len(places) - 1, 1))
    full = np.flatnonzero(np.diff(places) > 0)
    if len(full):
        p = np.clip(p, 1e-6, 1 - 1e-6)
        most = np.maximum.reduceat(p, places[full])
        out[full, 0] = np.log(most / (1 - most))
        out[full, 1] = np.log(np.add.reduceat(np.where(p >= 0.05, p, 0), places[full]) + 1e-5)
    return out


@dataclass
class _Batch:
    """The tokens of some labelled texts: features, whether a token begins a text, where texts begin, labels."""

    f: np.ndarray
    first: np.ndarray
    places: np.ndarray
    toxic: np.ndarray


def _batches(texts: list[bytes], toxic: np.ndarray) -> list[_Batch]:
    """The texts that have words, about BATCH_TOKENS tokens (or one text) at once."""
    out, held, size = [], [], 0

    def close() -> None:
        words = Pieces([texts[i] for i in held], _SEPARATORS, lower=True)
        full = np.diff(words.first) > 0
        if full.any():
            out.append(_Batch(features(words), starts_of(words), words.first[:-1][full], toxic[held][full]))

    for i, t in enumerate(texts):
        held.append(i)
        size += len(t)
        if size > 6 * BATCH_TOKENS:
            close()
            held, size = [], 0
    if held:
        close()
    return out


def _step(model: Crf, b: _Batch) -> tuple[float, np.ndarray, np.ndarray]:
    """The log likelihood of a batch's labels, its gradient by each token's emission and by trans."""
    p, none, joint = marginals(b.first, model.emissions(b.f), model.trans, fit=True)
    clean = np.exp(np.minimum(np.add.reduceat(none, b.places), -1e-12))
    some = 1 - clean
    right, wrong = np.where(b.toxic == 1, 1 - WRONG, WRONG), np.where(b.toxic == 1, WRONG, 1 - WRONG)
    seen = some * right + clean * wrong
    # Given the label, the expected counts of tag 1 are right / seen times those without it (a text without tag 1 has none).
    by = right / seen - 1
    by = np.repeat(by, np.diff(np.append(b.places, len(p))))
    g = np.einsum("n,nij->ij", by, joint)
    g[0, 0] = 0  # the weight of (0, 0) stays 0, as of every text without tag 1
    return float(np.log(seen).sum()), by * p, g


def train(texts: list[bytes], toxic: np.ndarray) -> Crf:
    """Fits the field and the score's curve on labelled texts. Without a toxic text, or a clean one, every score is near 0."""
    model = Crf()
    order = np.random.default_rng(7).permutation(len(texts))
    fresh, held = order[order % HELD > 0], order[order % HELD == 0]
    if not toxic[fresh].any() or toxic[fresh].all():
        return model
    batches = _batches([texts[i] for i in fresh], toxic[fresh])
    theta = np.zeros(BUCKETS + 5, np.float32)  # weights, bias, trans
    theta[BUCKETS] = START
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    checks = _batches([texts[i] for i in held], toxic[held])
    best, kept, steps, worse = -np.inf, theta.copy(), 0, 0

    def taken(now: np.ndarray) -> None:
        model.weights, model.bias, model.trans = now[:BUCKETS], float(now[BUCKETS]), now[BUCKETS + 1 :].reshape(2, 2).astype(np.float64)

    for _ in range(PASSES):  # Adam on the log likelihood with a quadratic penalty
        for b in batches:
            taken(theta)
            _, token, pairs = _step(model, b)
            g = np.empty_like(theta)
            g[:BUCKETS] = np.bincount(b.f.reshape(-1), np.outer(token, VALUES).reshape(-1), BUCKETS)
            g[BUCKETS] = token.sum()
            g[BUCKETS + 1 :] = pairs.reshape(-1)
            g /= len(b.places)
            g -= PENALTY * theta
            steps += 1
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            theta += RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6)
        taken(theta)
        value = sum(_step(model, b)[0] for b in checks)
        if value > best:
            best, worse = value, 0
            kept[:] = theta
        elif (worse := worse + 1) == PATIENCE:
            break
    taken(kept)
    del batches, theta, m, v
    x, y = [], []
    for b in checks:
        x.append(_signals(marginals(b.first, model.emissions(b.f), model.trans), np.append(b.places, len(b.first))))
        y.append(b.toxic)
    x, y = np.concatenate(x) if x else np.empty((0, 2)), np.concatenate(y) if y else np.empty(0)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(2), np.ones(2))
    x = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    curve = np.zeros(3)
    for _ in range(20):  # Newton's steps with a quadratic penalty, on standardized signals
        q = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        h = (x * (q * (1 - q) + 1e-6)[:, None]).T @ x + CURVE_PENALTY * np.eye(3)
        curve += np.linalg.solve(h, x.T @ (y - q) - CURVE_PENALTY * curve)
    model.curve = np.concatenate(([curve[0] - (curve[1:] * mean / scale).sum()], curve[1:] / scale))
    return model


def _scores(batches: Iterator[pa.RecordBatch], model: Crf, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = texts_of(batch, "text")
        words = Pieces(texts, _SEPARATORS, lower=True)
        p = model.tag(words)
        x = _signals(p, words.first)
        score = 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ model.curve, -30, 30)))
        offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        hot = p >= 0.5
        for d in np.flatnonzero((score >= 0.5) & (np.diff(words.first) > 0)).tolist():
            hot[words.first[d] + p[words.first[d] : words.first[d + 1]].argmax()] = True
        hot = np.flatnonzero(hot)
        for i, d in zip(hot.tolist(), (np.searchsorted(words.first, hot, side="right") - 1).tolist(), strict=True):
            text, a, b = texts[d], int(words.starts[i] - offset[d]), int(words.ends[i] - offset[d])
            start = len(text[:a].decode("utf-8", "ignore"))
            spans[d].append((start, start + len(text[a:b].decode("utf-8", "ignore"))))
        kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(score, pa.float64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], [*names, "score", "spans"])


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, toxic) of the documents to learn from, one row for each.

    Of each label at most SAMPLE_TOXIC and SAMPLE_OTHER documents in the order of a hash of the id, and of those, in the
    same order, all that fit into SAMPLE_BYTES together (one that does not fit is left out, the next may fit). Only rows with
    crc32(id as text) mod 5 other than 0 count. Null ids, texts and labels are passed over; an id with several labels
    counts by the largest, one with several texts by the shortest.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(crc32_text("doc_id") % 5 != 0).withColumn("h", F.xxhash64("doc_id"))
    chosen = known.where("toxic = 1").orderBy("h", "doc_id").limit(SAMPLE_TOXIC).unionByName(known.where("toxic = 0").orderBy("h", "doc_id").limit(SAMPLE_OTHER))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    sizes = given.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("size").alias("size"), F.first("toxic").alias("toxic"), F.first("h").alias("h"))
    left, taken = SAMPLE_BYTES, []
    for r in sizes.orderBy("h", "doc_id").collect():  # as many rows as chosen at most
        if r.size <= left:
            left -= r.size
            taken.append((r.doc_id, r.size, r.toxic))
    ids = docs.sparkSession.createDataFrame(taken, "doc_id long, size int, toxic int")
    return given.withColumn("size", F.octet_length("text")).join(F.broadcast(ids), ["doc_id", "size"]).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Crf:
    """A model of sample(); empty tables give one that scores every document near 0."""
    rows = sample(docs, labels, id_col, text_col).orderBy("doc_id").toArrow()  # SAMPLE_BYTES of text at most
    return train(rows.column("text").cast(pa.binary()).to_pylist(), rows.column("toxic").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score, spans (code points of the offending tokens) and all columns in `row`.

    Only the text bears on the score: null counts as empty, texts without words get the lowest score, repeated rows get
    equal scores, rows with a null id are scored too. Whole texts are read; one text needs about 30 times its bytes of
    memory, and texts that are read together hold SLICE_BYTES. Columns may have any names, since they stay in `row`.
    """
    prepared(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct("*").alias("row"))
    schema = f"doc_id long, row {given.schema['row'].dataType.simpleString()}, score double, spans array<struct<start:int,end:int>>"
    return given.mapInArrow(lambda x: _scores(x, model, ["doc_id", "row"]), schema)


def op3_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(crc32_text("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))).alias("spans"))
