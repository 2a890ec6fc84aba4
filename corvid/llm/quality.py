"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled texts of quality 1; the unlabelled texts are a sample
of the web texts themselves.  A small network minimises the non-negative unbiased
risk ``pi R+(P) + max(0, R-(U) - pi R-(P))`` under a class prior ``pi``.  The prior is
estimated from positives and unlabelled texts alone: networks tell P from U on one half
of the sample and score the other; the smallest ratio of the shares of U and of P above
a score, with its confidence bound, gives the share of U that is like P.

Features are shape statistics of the whole text (bytes by class, word length,
repetition); labels, language, source and id are never among them.  They are
computed in Arrow batches: for the bounded training sample first, then for every document
as it is scored.

Edge cases: null and empty texts get the features of an empty text and a score;
repeated rows get equal scores; documents with contradicting labels count by each;
without labelled positives every score is 0.5; with fewer than ``LEAST`` positives the
whole sample serves both steps of the prior's estimate; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.shingles import words_of

#: Training rows taken at most, by the order of a hash of the id: positives, unlabelled.
MAX_POSITIVE = 6000
MAX_UNLABELLED = 12000
HIDDEN = 16
EPOCHS = 300
PRIOR_EPOCHS = 100
RATE = 0.02
SEED = 7
#: Positives from which on the prior is estimated on halves that the network has not seen.
LEAST = 20
#: Chance that the confidence bound of the prior fails, and its slack.
DELTA, SLACK = 0.1, 0.01


def _is(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode("latin-1"))] = 1
    return out


def _span(a: int, b: int) -> np.ndarray:
    out = np.zeros(256)
    out[a:b] = 1
    return out


_CLASSES = np.stack(
    [
        _span(97, 123), _span(65, 91), _span(48, 58), _span(128, 256), _is(" \t\x0b\x0c\r"), _is("\n"), _is("."), _is(","), _is("!"), _is("?"),
        _is("|"), _is("*#$%&@^~"), _is("-_=+<>/\\"), _is("()[]{}"), _is("'\":;`"),
    ],
    axis=1,
)
N_FEATURES = _CLASSES.shape[1] + 7


def features(text: bytes, words: np.ndarray) -> np.ndarray:
    """Shape statistics of one text."""
    out = np.zeros(N_FEATURES)
    n, w = len(text), len(words)
    out[0] = np.log1p(n)
    if not n or not w:
        return out
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[1 : 1 + _CLASSES.shape[1]] = np.sqrt(hist @ _CLASSES / n)
    at = 1 + _CLASSES.shape[1]
    out[at] = n / w / 8
    out[at + 1] = (words[1:] == words[:-1]).mean() if w > 1 else 0
    out[at + 2] = (words[2:] == words[:-2]).mean() if w > 2 else 0
    few = len(np.unique(words))
    out[at + 3] = few / w
    out[at + 4] = np.log1p(few) / np.log1p(w)
    out[at + 5] = np.sqrt(hist.max() / n)
    return out


def _rows(batch: pa.RecordBatch, text_col: str) -> np.ndarray:
    texts = [t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
    return np.array([features(t, w) for t, w in zip(texts, words_of(texts), strict=True)]).reshape(len(texts), N_FEATURES)


def feature_table(docs: DataFrame) -> DataFrame:
    """x (features, 32-bit floats as bytes) and every other column than ``text`` of the documents."""
    others = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([row.tobytes() for row in _rows(b, "text").astype(np.float32)], pa.binary())
            yield pa.RecordBatch.from_pydict({f.name: b.column(f.name) for f in others} | {"x": x})

    return docs.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["x binary"]))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)).cast("int")


class Model:
    """A network with one hidden layer; ``score`` gives the probability of quality 1."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def score(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(0, ((x - self.mean) / self.scale).clip(-8, 8) @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-(h @ self.w2 + self.b2).clip(-30, 30)))


def _trained(positive: np.ndarray, unlabelled: np.ndarray, pull: Callable[[np.ndarray, int], np.ndarray], seed: int, epochs: int) -> Model:
    """Adam on the whole sample; ``pull`` gives the risk's slope by each row's logit from all scores and the number of positives."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = unlabelled.mean(0, dtype=np.float64), unlabelled.std(0, dtype=np.float64) + 1e-3
    x = ((both - mean) / scale).clip(-8, 8)
    d = x.shape[1]
    p = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.array(0.0)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, epochs + 1):
        h = np.maximum(0, x @ p[0] + p[1])
        g = pull(1 / (1 + np.exp(-(h @ p[2] + p[3]).clip(-30, 30))), len(positive))
        back = np.outer(g, p[2]) * (h > 0)
        grads = [x.T @ back + 1e-4 * p[0], back.sum(0), h.T @ g + 1e-4 * p[2], np.array(g.sum())]
        for i, q in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * q
            v[i] = 0.999 * v[i] + 0.001 * q * q
            p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, *p)


def _apart(s: np.ndarray, n_p: int) -> np.ndarray:
    """Slope of the plain logistic risk of P against U, both of weight one half."""
    return np.concatenate([(s[:n_p] - 1) / n_p, s[n_p:] / (len(s) - n_p)]) / 2


def prior_of(positive: np.ndarray, unlabelled: np.ndarray, seed: int = SEED, epochs: int = PRIOR_EPOCHS) -> float:
    """The share of ``unlabelled`` that is like ``positive``: above the score where it is bounded best."""
    both = [positive, unlabelled]
    if min(len(positive), len(unlabelled)) < LEAST:
        scored = [_trained(*both, _apart, seed, epochs).score(x) for x in both]
    else:
        scored = [np.empty(len(x)) for x in both]
        for half in (0, 1):
            model = _trained(*[x[1 - half :: 2] for x in both], _apart, seed, epochs)
            for x, s in zip(both, scored, strict=True):
                s[half::2] = model.score(x[half::2])
    p, u = np.sort(scored[0]), np.sort(scored[1])
    above_p, above_u = 1 - np.searchsorted(p, p) / len(p), 1 - np.searchsorted(u, p) / len(u)
    doubt = np.sqrt(np.log(4 / DELTA) / 2) * (len(u) ** -0.5 + len(p) ** -0.5)
    best = np.argmin((above_u + (1 + SLACK) * doubt) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def risk_slope(s: np.ndarray, n_p: int, pi: float) -> np.ndarray:
    """Slope of the non-negative risk by each row's logit, from scores ``s`` of ``n_p`` positives and then the unlabelled.

    Losses are logistic: that of P as positive falls by s - 1, that of a set as negative by s."""
    n_u, loss = len(s) - n_p, -np.log1p(-s.clip(0, 1 - 1e-12))
    if loss[n_p:].mean() >= pi * loss[:n_p].mean():
        return np.concatenate([pi * ((s[:n_p] - 1) - s[:n_p]) / n_p, s[n_p:] / n_u])
    # the estimated risk fell below nought: step back up
    return np.concatenate([pi * s[:n_p] / n_p, -s[n_p:] / n_u])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, seed: int = SEED, epochs: int = EPOCHS) -> Model | None:
    """Minimise the non-negative risk on the whole sample, under an estimated prior if none is given; None without positives."""
    if not len(positive) or not len(unlabelled):
        return None
    pi = prior_of(positive, unlabelled, seed) if prior is None else prior

    return _trained(positive, unlabelled, lambda s, n_p: risk_slope(s, n_p, pi), seed, epochs)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on a bounded sample of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), fold 1 left out."""
    fold = fold_of(F.col("doc_id")) != 1
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & fold)
    mark = F.xxhash64("doc_id", F.lit("sample"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    positive = known.where("quality = 1").select("doc_id").distinct().orderBy(mark, "doc_id").limit(MAX_POSITIVE).withColumn("known", F.lit(1))
    others = slim.where(F.col("doc_id").isNotNull() & fold).select("doc_id").distinct().orderBy(mark, "doc_id").limit(MAX_UNLABELLED).withColumn("known", F.lit(0))
    # at most MAX_POSITIVE + MAX_UNLABELLED ids
    sample = slim.join(F.broadcast(positive.unionByName(others)), "doc_id")
    got = feature_table(sample).orderBy(mark, "doc_id").limit(2 * (MAX_POSITIVE + MAX_UNLABELLED)).collect()
    x, known_ = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(-1, N_FEATURES), np.array([r["known"] for r in got])
    return fit(x[known_ == 1], x[known_ == 0])


def _judged(model, b: pa.RecordBatch, text_col: str) -> np.ndarray:
    return model.value.score(_rows(b, text_col)) if model.value else np.full(b.num_rows, 0.5)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(_judged(model, b, "text"), pa.float64())})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is predicted to be of quality 1, all columns kept."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_judged(model, b, "text") >= 0.5))

    return docs.mapInArrow(run, docs.schema)
