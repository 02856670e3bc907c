"""Quality of text: random-indexing word vectors, pooled per document, and a small network.

Each word that makes up at least one in OWN of all words has a vector of its
own; so there are at most OWN of them, whatever the corpus.  Rarer words share
RARE vectors by hash, and shapes of words (case, last sign, length) have
SHAPES.  A row has a fixed sparse index vector of +1 and -1; its vector is the
sum of the index vectors that stand near it in all documents.  A document's
features are pooled from its words' and shapes' vectors; a two-layer network
in numpy turns them into a probability, whose temperature is set on rows that
it was not trained on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.labelled import SAMPLE, with_labels
from tessella.llm.words import U, Words, blocks, given, mix, returned, tune, utf8
from tessella.plans.store import Scratch

OWN, RARE, SHAPES = 1 << 14, 1 << 13, 1 << 13
BUCKETS, DIM, ONES, WINDOW = OWN + RARE + SHAPES, 32, 2, 2
CHUNK, SLICE = 256, 128
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 128, 3e-3, 1e-3


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the ONES non-zero components of each bucket's index vector."""
    h = mix(np.arange(BUCKETS * ONES, dtype=U) + U(99)).reshape(BUCKETS, ONES)
    return (h % U(DIM)).astype(np.int64), np.where(h >> U(63), 1, -1)


PLACE, SIGN = index_vectors()
CODE = PLACE + DIM * (SIGN < 0)  # pluses and minuses are counted apart
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, np.int64)
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER[128:] = 1


def frequent_words(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the words that make up at least one in OWN of all words, counted over all whole texts."""

    def run(batches):
        for block in blocks(batches, max_bytes=8 << 20, max_rows=1 << 14):
            words, n = np.unique(Words([utf8(x) for x in block["text"]]).hash, return_counts=True)
            yield pd.DataFrame({"word": words.view(np.int64), "n": n})

    counted = docs.select("text").mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = Scratch(docs.sparkSession, "words").keep(counted)
    total = counted.agg(F.sum("n")).first()[0] or 0
    rows = counted.where(F.col("n") * OWN >= total).select("word").toPandas()  # at most OWN rows
    return np.sort(rows["word"].to_numpy(np.int64).view(U))


def buckets(texts: list[str | None], own: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of a block with the rows of each word and of its shape; ``own`` are the hashes of words with rows of their own."""
    raw = [utf8(x, lower=False) for x in texts]
    words = Words([x.lower() for x in raw])
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    upper, letters = (np.r_[0, np.cumsum(kind[data])] for kind in (_UPPER, _LETTER))
    s, e = words.start, words.end
    n, up, let = e - s, upper[e] - upper[s], letters[e] - letters[s]
    first, last, before = data[s], data[e - 1], data[np.maximum(s, e - 2)]
    case = np.select([let == 0, up == 0, (up == let) & (let > 1), (up == 1) & (_UPPER[first] == 1)], [0, 1, 2, 3], 4)
    sign = np.where(_LETTER[last] == 0, last, 0).astype(np.int64)
    twice = (sign > 0) & (last == before) & (n > 1)
    size = np.select([n == 1, n < 4, n < 8, n < 16], [0, 1, 2, 3], 4)
    shape = ((case * 256 + sign) * 2 + twice) * 5 + size
    row = (words.hash % U(RARE)).astype(np.int64) + OWN
    if len(own):
        at = np.minimum(np.searchsorted(own, words.hash), len(own) - 1)
        row = np.where(own[at] == words.hash, at, row)
    return words, row, (mix(shape.astype(U) + U(5)) % U(SHAPES)).astype(np.int64) + (OWN + RARE)


def context_sums(docs: DataFrame, own: np.ndarray) -> np.ndarray:
    """The vector of each row: for words the index vectors of words within WINDOW, for shapes those of the shapes beside them, for both each other's, summed over all whole texts.

    Each task adds up a table of fixed size and sends it in CHUNK-row pieces,
    so that the sums are merged piece by piece in parallel.
    """
    known = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches):
        signed = np.zeros(2 * BUCKETS * DIM, np.int64)
        for block in blocks(batches, max_bytes=4 << 20, max_rows=1 << 14):
            words, w, s = buckets(block["text"].tolist(), known.value)
            if not len(w):
                continue
            doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
            pairs = [(w, s), (s, w)]
            for d in range(1, WINDOW + 1):
                same = np.flatnonzero(doc[d:] == doc[:-d])
                pairs += [(w[same], w[same + d]), (w[same + d], w[same])]
                if d == 1:
                    pairs += [(s[same], s[same + d]), (s[same + d], s[same])]
            to, of = np.concatenate([p[0] for p in pairs]) * (2 * DIM), np.concatenate([p[1] for p in pairs])
            for j in range(ONES):
                signed += np.bincount(to + CODE[of, j], minlength=len(signed))
        parts = signed.reshape(BUCKETS, 2, DIM)
        total = parts[:, 0] - parts[:, 1]
        table = total.reshape(-1, CHUNK * DIM)
        some = np.flatnonzero(table.any(axis=1))
        yield pd.DataFrame({"piece": some.astype(np.int32), "sums": [table[i].astype("<i8").tobytes() for i in some]})

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8") for x in rows["sums"])
        return pd.DataFrame({"piece": [key[0]], "sums": [total.tobytes()]})

    found = docs.select("text").mapInPandas(run, "piece int, sums binary").groupBy("piece").applyInPandas(merge, "piece int, sums binary").collect()
    out = np.zeros((BUCKETS // CHUNK, CHUNK * DIM))
    for piece, sums in found:  # BUCKETS * DIM numbers, whatever the input
        out[piece] = np.frombuffer(sums, "<i8")
    return out.reshape(BUCKETS, DIM)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors: the sums, centred, with a share of the row's own index vector so that rare words differ."""
    own = np.zeros((BUCKETS, DIM))
    for j in range(ONES):
        np.add.at(own, (np.arange(BUCKETS), PLACE[:, j]), SIGN[:, j])
    unit = lambda x: x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    near = unit(sums)
    weight = np.linalg.norm(sums, axis=1)
    near = near - (near * weight[:, None]).sum(axis=0) / max(1e-9, weight.sum())
    return unit(near + 0.5 * unit(own)).astype(np.float32)


FEATURES = 3 * DIM + 3


def features(texts: list[str | None], vectors: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A row per text: the mean of its words' vectors and its length, mean and deviation of its shapes' vectors, the logarithm of the number of words, the part of words that are different.  Texts without words have zeros."""
    words, w, s = buckets(texts, own)
    n = np.diff(words.first)
    out = np.zeros((len(n), FEATURES))
    some = np.flatnonzero(n)
    if not len(some):
        return out
    at, count = words.first[:-1][some], n[some][:, None]
    doc = np.repeat(np.arange(len(n)), n)
    mean = np.add.reduceat(vectors[w], at, axis=0) / count
    out[some, :DIM] = mean
    for a in range(0, len(n), SLICE):  # a text has few different shapes: their counts, some texts at a time
        lo, hi = words.first[a], words.first[min(a + SLICE, len(n))]
        if lo == hi:
            continue
        kinds, place = np.unique(s[lo:hi], return_inverse=True)
        rows = min(SLICE, len(n) - a)
        part = np.bincount((doc[lo:hi] - a) * len(kinds) + place, minlength=rows * len(kinds)).reshape(rows, len(kinds))
        part = part / np.maximum(1, n[a : a + rows, None])
        shape = part @ vectors[kinds]
        out[a : a + rows, DIM : 2 * DIM] = shape
        out[a : a + rows, 2 * DIM : 3 * DIM] = np.sqrt(np.maximum(0, part @ vectors[kinds] ** 2 - shape**2))
    out[some, -3] = np.linalg.norm(mean, axis=1)
    pair = np.unique(doc * BUCKETS + w)
    out[:, -2] = np.log1p(n)
    out[some, -1] = (np.bincount(pair // BUCKETS, minlength=len(n)) / np.maximum(1, np.minimum(n, BUCKETS)))[some]
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Network:
    """Adam on the cross entropy with weight decay; every fifth row sets the temperature.  Without both labels the share of ones decides."""
    share = float((y.sum() + 1) / (len(y) + 2))
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0) + 1e-3 if len(x) else np.ones(x.shape[1])
    net = Network(x.mean(axis=0) if len(x) else np.zeros(x.shape[1]), scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return net
    aside = np.arange(len(y)) % 5 == 4
    z, t = ((x - net.mean) / net.scale)[~aside], y[~aside]
    net.w2 = rng.normal(0, 0.1, HIDDEN)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(t))
        for a in range(0, len(t), BATCH):
            rows = order[a : a + BATCH]
            h = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -50, 50)))
            g = (p - t[rows]) / len(rows)
            gh = np.outer(g, params[2]) * (1 - h * h)
            grads = [z[rows].T @ gh + DECAY * params[0], gh.sum(axis=0), h.T @ g + DECAY * params[2], np.array([g.sum()])]
            step += 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                params[i] -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if aside.any():
        logit, t = net.logits(x[aside]), y[aside]
        grid = np.geomspace(0.5, 10, 60)
        loss = [np.logaddexp(0, np.where(t == 1, -logit, logit) / k).mean() for k in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class Model:
    own: np.ndarray
    vectors: np.ndarray
    network: Network


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """Word vectors from all documents; the network from at most ``bound`` labelled ones."""
    spark = docs.sparkSession
    tune(spark)
    own = frequent_words(docs)
    vectors = word_vectors(context_sums(docs, own))
    kept = spark.sparkContext.broadcast((vectors, own))  # of fixed size: BUCKETS * DIM numbers, OWN hashes

    def run(batches):
        for block in blocks(batches):
            x = features(block["text"].tolist(), *kept.value)
            yield pd.DataFrame({"doc_id": block["doc_id"], "label": block["label"], "x": [r.tobytes() for r in x]})

    rows = with_labels(docs, labels, "quality", bound).mapInPandas(run, "doc_id long, label int, x binary").toPandas().sort_values("doc_id")
    x = np.array([np.frombuffer(r) for r in rows["x"]]).reshape(len(rows), FEATURES)
    return Model(own, vectors, train(x, rows["label"].to_numpy(np.float64)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text -> doc_id, score.  Texts without words and null texts have the network's value for a text without words; null ids stay null; repeated rows stay; other columns are ignored; an empty table gives an empty table."""
    tune(docs.sparkSession)
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = kept.value
        for block in blocks(batches):
            value = m.network.probability(features(block["text"].tolist(), m.vectors, m.own))
            yield pd.DataFrame({"doc_id": block["doc_id"], "score": value})

    return returned(given(docs, "text").mapInPandas(run, "doc_id string, score double"))
