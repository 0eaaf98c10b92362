"""Toxicity scores from subword-bag embeddings.

A word is the mean of its character n-grams' vectors (hashed, with word ends marked), so an unseen misspelling shares
most of its vector with what it was made from. A passage of PASSAGE words is the mean of its words; a linear softmax
scores it. Vectors and softmax are trained jointly in numpy. A text scores as its most toxic passage does, so length
doesn't dilute it; training follows the passage that scores highest. A logistic curve fitted on texts that training
left out makes the scores probabilities at the true rate of labels.

As everything after the vectors is linear, scoring looks each n-gram's share of the logit up in one table.

Cases: a null, empty or wordless text scores as a passage of no words does; repeated rows are scored each; without
labels of both kinds every score is the share of toxic labels, 0 if there are none; null labels teach nothing; a text
of any length is read whole; an empty table gives no rows; a column ``score`` is replaced, all others are kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.llm.common import handed, map_texts, texts_as_bytes

BUCKETS, WIDTH, GRAMS, PASSAGE = 1 << 17, 8, (3, 4, 5), 6
#: Bound of what is learnt from: rows of either label, each with its whole text.
SAMPLE = 5000
STEPS, BATCH, RATE, SEED = 800, 64, 0.2, 7

_WORD = re.compile(r"\w+")
_FACTORS = (np.random.default_rng(SEED).integers(1, 1 << 62, 8) * 2 + 1).astype(np.uint64)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams, and how many each word has."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    found, owners = [], []
    for n in GRAMS:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ points[k : len(points) - n + 1 + k]) * _FACTORS[k]
            h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        found.append((h[inside] % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(owner[: len(h)][inside])
    buckets, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.bincount(owners, minlength=len(words))


def passages(n: int, size: int = PASSAGE) -> np.ndarray:
    """Starts of a text's passages: every word that has a whole passage after it, or the first."""
    return np.arange(max(1, n - size + 1))


def _means(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Means of consecutive runs (none empty)."""
    if not len(sizes):
        return np.zeros(0)
    return np.add.reduceat(values, np.cumsum(sizes) - sizes, axis=0) / (sizes[:, None] if values.ndim > 1 else sizes)


def best_passage(scores: np.ndarray) -> tuple[float, int]:
    """The highest mean of a passage of a text with these words' scores, and its start; of no words 0."""
    if not len(scores):
        return 0.0, 0
    starts, size = passages(len(scores)), min(PASSAGE, len(scores))
    total = np.concatenate([[0.0], np.cumsum(scores)])
    means = (total[starts + size] - total[starts]) / size
    k = int(means.argmax())
    return float(means[k]), int(starts[k])


class Model:
    """Shares of the logit by n-gram bucket, its constant, and the logistic curve (slope, shift)."""

    def __init__(self, shares: np.ndarray, slope: float, shift: float):
        self.shares, self.slope, self.shift = shares, slope, shift

    def words(self, words: list[str]) -> np.ndarray:
        buckets, sizes = ngrams(words)
        return _means(self.shares[buckets], sizes) if len(sizes) else np.zeros(0)

    def probability(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -50, 50)))


def numbered(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with each text's distinct words (``text`` itself) and the numbers in them of all its words (``numbers``, int32 as bytes)."""

    def make():
        def run(batch):
            coded = [pa.array(words_of(t.decode("utf-8", "replace")), pa.string()).dictionary_encode() for t in texts_as_bytes(batch.column(text))]
            words = pa.array([c.dictionary.to_pylist() for c in coded], pa.list_(pa.string()))
            return [words, pa.array([c.indices.to_numpy().astype(np.int32).tobytes() for c in coded], pa.binary())]

        return run

    fields = T.StructType([T.StructField(text, T.ArrayType(T.StringType())), T.StructField("numbers", T.BinaryType())])
    return map_texts(docs, text, fields, make)


def gradient(vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray, grams: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The softmax's loss over bags of words, the vectors that it hangs on, and its slopes by these, the weights and the bias.

    ``grams``: buckets of all bags' words' n-grams, of which each word has ``sizes``; each bag has ``lengths`` words.
    """
    text_of = np.repeat(np.repeat(np.arange(len(lengths)), lengths), sizes)
    weight = np.repeat(1 / sizes, sizes) / lengths[text_of]
    picked = vectors[grams] * weight[:, None]
    means = np.stack([np.bincount(text_of, picked[:, d], len(lengths)) for d in range(vectors.shape[1])], axis=1)
    logits = means @ weights + bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    own = np.arange(len(lengths))
    loss = float(-np.log(np.maximum(p[own, labels], 1e-300)).sum())
    p[own, labels] -= 1
    d_means = p @ weights.T
    touched, where = np.unique(grams, return_inverse=True)
    step = np.stack([np.bincount(where, weight * d_means[text_of, d], len(touched)) for d in range(vectors.shape[1])], axis=1)
    return loss, touched, step, means.T @ p, p.sum(axis=0)


def train(words: list[str], ids: list[np.ndarray], labels: np.ndarray, rate: float, seed: int = SEED) -> Model:
    """``ids``: each text's words by their places in ``words``; ``rate``: the share of toxic labels outside the sample,
    which has as many of either kind as it can."""
    rng = np.random.default_rng(seed)
    parts = [ngrams(words[a : a + 50_000]) for a in range(0, len(words), 50_000)] or [ngrams([])]
    buckets, sizes = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    first = np.cumsum(sizes) - sizes
    vectors = rng.uniform(-1, 1, (BUCKETS, WIDTH)) / WIDTH
    weights, bias = rng.uniform(-1, 1, (WIDTH, 2)) * 0.5, np.zeros(2)
    g_vectors, g_weights, g_bias = np.full(BUCKETS, 1e-8), np.full((WIDTH, 2), 1e-8), np.full(2, 1e-8)
    order = rng.permutation(len(ids))
    order = order[[len(ids[k]) > 0 for k in order]]
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    for _ in range(-(-STEPS * BATCH // max(1, len(used)))):
        shares = vectors @ (weights[:, 1] - weights[:, 0])
        scores = _means(shares[buckets], sizes)
        for a in range(0, len(used), BATCH):
            rows = used[a : a + BATCH].tolist()
            starts = [best_passage(scores[ids[k]])[1] for k in rows]
            bags = [ids[k][s : s + PASSAGE] for k, s in zip(rows, starts, strict=True)]
            flat = np.concatenate(bags)
            n = sizes[flat]
            grams = buckets[np.repeat(first[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            _, touched, step, d_weights, d_bias = gradient(vectors, weights, bias, grams, n, np.array([len(b) for b in bags]), labels[rows])
            g_vectors[touched] += (step**2).mean(axis=1)
            vectors[touched] -= RATE * step / np.sqrt(g_vectors[touched])[:, None]
            g_weights += d_weights**2
            weights -= RATE * d_weights / np.sqrt(g_weights)
            g_bias += d_bias**2
            bias -= RATE * d_bias / np.sqrt(g_bias)
        used = rng.permutation(used)
    shares = vectors @ (weights[:, 1] - weights[:, 0]) + (bias[1] - bias[0])
    scores = _means(shares[buckets], sizes)
    some = held if len(np.unique(labels[held])) == 2 else order
    best, y = np.array([best_passage(scores[ids[k]])[0] for k in some]), labels[some]
    weight = np.where(y == 1, rate / max(1, (y == 1).sum()), (1 - rate) / max(1, (y == 0).sum()))
    slope, shift = _curve(best, y, weight)
    return Model(shares.astype(np.float32), slope, shift)


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the weighted logistic regression of y on x, by Newton's steps, slightly held back."""
    mean, scale = float(np.average(x, weights=weight)), float(x.std()) or 1.0
    z = np.stack([(x - mean) / scale, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(2) * 1e-3
        step = np.linalg.solve(hessian, z.T @ (weight * (y - p)) - 1e-3 * beta)
        beta += np.clip(step, -2, 2)
    return float(beta[0] / scale), float(beta[1] - beta[0] * mean / scale)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model | float:
    """The model from about ``sample`` rows of either label, chosen by a hash; a constant score if only one label is there."""
    labels = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg((F.max(label) > 0).cast("int").alias("_y"))
    counts = {r[0]: r[1] for r in labels.groupBy("_y").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return float(counts.get(1, 0) > 0)
    share = F.when(F.col("_y") == 1, min(1.0, sample / counts[1])).otherwise(min(1.0, sample / counts[0]))
    chosen = labels.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text")).join(F.broadcast(chosen), key)
    rows = numbered(rows.select("_text", "_y", F.sha2("_text", 256).alias("_order")), "_text").toArrow().combine_chunks()
    # rows in an order of their own, so that the model doesn't hang on the order of partitions
    rows = rows.sort_by([("_order", "ascending"), ("_y", "ascending")])
    y = rows["_y"].to_numpy().astype(np.int64)
    if len(np.unique(y)) < 2:
        return counts[1] / total
    coded = rows["_text"].combine_chunks().flatten().dictionary_encode()
    places, ends = coded.indices.to_numpy().astype(np.int32), np.cumsum([len(x) for x in rows["_text"]])
    ids = [places[e - len(w) : e][np.frombuffer(n.as_py(), np.int32)] for w, n, e in zip(rows["_text"], rows["numbers"], ends.tolist(), strict=True)]
    return train(coded.dictionary.to_pylist(), ids, y, counts[1] / total)


def score(docs: DataFrame, model: Model | float, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, from 0 to 1."""
    sent = handed(docs.sparkSession, model)

    def make():
        model = sent()

        def run(batch):
            texts = texts_as_bytes(batch.column(text))
            if isinstance(model, float):
                return [pa.array(np.full(len(texts), model))]
            split = [words_of(t.decode("utf-8", "replace")) for t in texts]
            sizes = [len(w) for w in split]
            coded = pa.array([w for ws in split for w in ws], pa.string()).dictionary_encode()
            scores = model.words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()] if len(coded) else np.zeros(0)
            ends = np.cumsum(sizes)
            best = np.array([best_passage(scores[e - n : e])[0] for e, n in zip(ends, sizes, strict=True)])
            return [pa.array(model.probability(best))]

        return run

    return map_texts(docs, text, T.StructType([T.StructField("score", T.DoubleType(), False)]), make)
