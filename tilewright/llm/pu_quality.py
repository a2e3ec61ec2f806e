"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and a sample of unlabelled web text train a linear model on text features by minimising the
non-negative unbiased risk  pi * R+(positive as positive) + max(0, R-(unlabelled as negative) - pi * R-(positive as
negative))  with the sigmoid loss; where the second part is negative, the step goes against it. Negative labels are never read.

pi, the class prior, is estimated: a first model, fitted on half of either sample with pi = 0.5, ranks the other halves, and pi is the
least ratio, over thresholds that keep most positives, of the share of unlabelled rows above the threshold to the share of positive rows above it (plus
their sampling error): positives make up pi times the positive share of any top part of the unlabelled rows, or
less than all of it. The score is the posterior  pi * positive density / unlabelled density  of the final margin, as the rising
function that minimises the unbiased squared risk over both samples, with a hundredth of a logistic mixed in to tell ties apart.

Features are a text's byte frequencies (square roots, so that rare signs show), the logarithm of its length, its mean word
and line lengths, and how often a byte repeats the one before it. Nothing else about a row enters a score.

``SAMPLE`` bounds the positive and the unlabelled rows that are fitted, each drawn by digest from the whole
table; scoring covers every row. Where rows repeat a doc_id, the one with the least features is fitted.

Defined cases: a null text is empty and has the features of an empty text, and a score; with no positive rows every score is 0.5; a
doc_id that is null has no label; labels with null quality are none; where labels repeat a doc_id the largest holds; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import runs_of, text_bytes
from tilewright.llm.shingles import SPACE, word_bounds, word_hashes

#: Rows of either kind that are fitted, at most.
SAMPLE = 6000
THRESHOLD = 0.3
#: Share of the positives above a threshold from which the prior may be read.
MOST = 0.85
FOLDS = 5
WIDTH = 256 + 8


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row a text raw[start:end]; texts lie one after the other."""
    out = np.zeros((len(starts), WIDTH), np.float32)
    for i, j in runs_of(starts, ends, 1 << 18):
        base = int(starts[i])
        data = raw[base : int(ends[j - 1])]
        first, end = word_bounds(data, starts[i:j] - base, ends[i:j] - base, SPACE)
        words = word_hashes(data, first, end)
        cut = np.searchsorted(first, np.concatenate([starts[i:j], ends[j - 1 : j]]) - base).tolist()
        for k in range(i, j):
            b = data[int(starts[k]) - base : int(ends[k]) - base]
            n = len(b)
            if not n:
                continue
            count, w = np.bincount(b, minlength=256), words[cut[k - i] : cut[k - i + 1]]
            row = out[k]
            row[:256] = np.sqrt(count / n)
            row[256] = np.log1p(n) / 10
            row[257] = min(2.0, n / (len(w) + 1) / 10)
            row[258] = np.log1p(n / (count[10] + 1)) / 10
            row[259] = np.count_nonzero(b[1:] == b[:-1]) / n * 4
            row[260] = np.count_nonzero(count) / 64
            if len(w) > 1:
                again = np.count_nonzero(w[1:] == w[:-1]) / (len(w) - 1)
                row[261], row[262] = np.sqrt(again), min(1.0, 5 * again)
                row[263] = len(np.unique(w)) / len(w)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk_and_slope(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Both parts of the risk (positives as positive; unlabelled less positives as negative) and their slopes. Rows end with a 1."""
    gp, gu = _sigmoid(p @ w), _sigmoid(u @ w)  # loss as negative: g; as positive: 1 - g
    dp, du = (gp * (1 - gp)) @ p / len(p), (gu * (1 - gu)) @ u / len(u)
    return prior * float(1 - gp.mean()), float(gu.mean() - prior * gp.mean()), -prior * dp, du - prior * dp


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 2000, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last one is the bias) by full-batch Adam on the non-negative risk."""
    p, u = (np.hstack([x, np.ones((len(x), 1))]).astype(np.float32) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        _, negative, up, down = risk_and_slope(w.astype(np.float32), p, u, prior)
        grad = (-down if negative < 0 else up + down) + decay * np.concatenate([w[:-1], [0.0]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from the margins of rows that the ranking model was not fitted on."""
    p, u = np.sort(positive), np.sort(unlabelled)
    at = p[:: max(1, len(p) // 200)]
    of_p, of_u = (1 - np.searchsorted(x, at) / len(x) for x in (p, u))
    error = lambda share, n: np.sqrt(share * (1 - share) / n) + 1 / n
    top = of_p >= MOST  # smaller parts would follow any difference between trusted and other positives
    ratio = (of_u + error(of_u, len(u)) + of_u * error(of_p, len(p)) / np.maximum(of_p, 1e-9)) / np.maximum(of_p, 1e-9)
    best = int(np.argmin(np.where(top, ratio, np.inf)))
    return float(np.clip(ratio[best], 0.02, 0.98))


def posterior(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Margins and probabilities of the rising function r that minimises mean r(u)**2 / 2 - prior * mean r(p) within [0, 1]: pools of
    neighbouring margins, joined while a lower one's ratio isn't smaller. A pool gives its ends; between pools r is straight."""
    at = np.unique(np.concatenate([positive, unlabelled]))
    up = prior * np.bincount(np.searchsorted(at, positive), minlength=len(at)) / len(positive)
    down = np.bincount(np.searchsorted(at, unlabelled), minlength=len(at)) / len(unlabelled)
    pools: list[list[float]] = []  # lowest margin, highest, positive weight, unlabelled weight
    for row in zip(at.tolist(), at.tolist(), up.tolist(), down.tolist()):
        pools.append(list(row))
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, high, more, rows = pools.pop()
            pools[-1][1], pools[-1][2], pools[-1][3] = high, pools[-1][2] + more, pools[-1][3] + rows
    place = np.array([x for low, high, _, _ in pools for x in (low, high)])
    ratio = np.array([min(1.0, more / rows) if rows else 1.0 for _, _, more, rows in pools])
    return place, np.repeat(ratio, 2)


class Model:
    def __init__(self, mean, scale, weights, prior=0.5, places=None, chances=None):
        self.mean, self.scale, self.weights, self.prior, self.places, self.chances = mean, scale, weights, prior, places, chances

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.margin(x)
        told = _sigmoid(margin / 8)
        return np.round(told if self.places is None else 0.99 * np.interp(margin, self.places, self.chances) + 0.01 * told, 6)


def _feature_rows(batches):
    for b in batches:
        x = features(*text_bytes(b.column("text")))
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "kind": b.column("kind"), "x": pa.array([r.tobytes() for r in x], pa.binary())})


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """The model from features of both samples, in any order that doesn't depend on what they are."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1))
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 0.02
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    prior = 0.5
    if min(len(p), len(u)) >= 40:
        first = fit_nnpu(p[::2], u[::2], 0.5, steps=400)
        margin = lambda x: x @ first[:-1] + first[-1]
        prior = estimate_prior(margin(p[1::2]), margin(u[1::2]))
    model = Model(mean, scale, fit_nnpu(p, u, prior), prior=prior)
    model.places, model.chances = posterior(model.margin(positive), model.margin(unlabelled), prior)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Only labels of rows outside the held-out fold are read. The driver gets at most 2 * sample rows of features (1 kB each), one a doc_id."""
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = F.xxhash64("doc_id", F.lit(29))
    learn = labels.where("doc_id is not null and quality is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    learn = learn.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("kind"))
    trusted = learn.where("kind = 1").orderBy(order, "doc_id").limit(sample).select("doc_id", F.lit(1).alias("kind"))
    web = text.where("doc_id is not null").select("doc_id").distinct().orderBy(order, "doc_id").limit(sample).select("doc_id", F.lit(2).alias("kind"))
    wanted = F.broadcast(trusted.unionByName(web))  # at most 2 * sample ids
    rows = text.join(wanted, "doc_id").select("doc_id", "kind", "text").mapInArrow(_feature_rows, "doc_id long, kind int, x binary")
    rows = rows.groupBy("doc_id", "kind").agg(F.min("x").alias("x")).toPandas()
    rows = rows.assign(order=[zlib.crc32(b"order" + str(i).encode()) for i in rows["doc_id"]]).sort_values(["kind", "order", "doc_id"])
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, WIDTH)
    kind = rows["kind"].to_numpy()
    return fit(x[kind == 1], x[kind == 2])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document row; no shuffle."""

    def run(batches):
        for b in batches:
            s = model.score(features(*text_bytes(b.column("text"))).astype(np.float64))
            ids = b.column("doc_id")
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "held_out": pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()), "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= THRESHOLD).astype(np.int32))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model predicts to be of quality; all columns stay. Null texts are scored as empty ones."""

    def run(batches):
        for b in batches:
            s = model.score(features(*text_bytes(b.column("text"))).astype(np.float64))
            yield b.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
