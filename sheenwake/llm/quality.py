"""Quality classifier learnt from positive and unlabelled texts (operator 10).

Trusted good texts are the positives; all other web text is unlabelled and holds good and bad.
A linear model on shape features minimises the non-negative unbiased risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

with the logistic loss, so that its output is a probability. The class prior is estimated from the
same samples: behind a score cut, the share of unlabelled texts over the share of positives bounds the
prior from above, and the best cut gives the estimate. Both samples are bounded (``max_rows`` each,
taken in the order of a hash of the id); scoring covers every text.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..session import cut_lineage
from .common import forget, raw, remainder

#: Marks counted on their own, and those counted together.
MARKS = b".,!?|;:\"'()-#$%&*"
OTHER = b"<>=+/\\@^_`{}[]~"
N_FEATURES = len(MARKS) + 13
#: Score from which a text counts as good.
ACCEPT = 0.7


def features(text: bytes) -> np.ndarray:
    """Shape of a text: case, digits, marks, word lengths, repeated words and lines. Empty: zeros."""
    out = np.zeros(N_FEATURES)
    words = text.split()
    if not words:
        return out
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    n = len(words)
    blank = h[32] + h[9:14].sum()
    chars = len(text) - h[128:192].sum() - blank
    upper, lower = h[65:91].sum(), h[97:123].sum()
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[:13] = (np.log1p(n), chars / n, upper / chars, lower / chars, h[48:58].sum() / chars,
                h[192:].sum() / chars, h[1:9].sum() / chars, n / len(set(words)) / np.log(n + 2),
                1 - len(set(lines)) / len(lines), len(lines) / n, np.log1p(max(map(len, words))),
                sum(h[c] for c in OTHER) / n, np.log1p(upper / n))
    out[13:] = [h[c] / n for c in MARKS]
    out[13:] = np.sqrt(out[13:])
    return out


@dataclass
class QualityModel:
    """Standardisation, weights (bias first) and the estimated class prior."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of a good text, for rows of features."""
        return 1 / (1 + np.exp(-np.clip(design(x, self.mean, self.scale) @ self.weights, -30, 30)))


def design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Bias, clipped standard scores and their squares."""
    z = np.clip((x - mean) / scale, -4, 4)
    return np.hstack([np.ones((len(z), 1)), z, z * z / 4])


def _descend(gradient, n: int, steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> np.ndarray:
    """Adam on a full-batch gradient."""
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for t in range(1, steps + 1):
        g = gradient(w) + decay * np.r_[0, w[1:]]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def estimate_prior(pos: np.ndarray, unl: np.ndarray, above=None) -> float:
    """Share of positives among unlabelled rows, by the best score cut on rows not fitted to.

    ``above(weights, cuts)`` counts all unlabelled rows and those with a score over each cut; without it, the half of
    ``unl`` that is not fitted to stands for them.
    """
    fit_p, fit_u, p, u = pos[::2], unl[::2], pos[1::2], unl[1::2]
    if min(map(len, (fit_p, fit_u, p, u))) < 10:
        return 0.5
    w = _descend(lambda w: (-fit_p.T @ _sigmoid(-(fit_p @ w)) / len(fit_p)
                            + fit_u.T @ _sigmoid(fit_u @ w) / len(fit_u)) / 2, pos.shape[1], 100)
    sp = np.sort(p @ w)
    cuts = np.quantile(sp, np.linspace(0, 0.9, 91))
    qp = 1 - np.searchsorted(sp, cuts) / len(sp)
    n, over = above(w, cuts) if above else (len(u), _over(u @ w, cuts))
    qu = over / n
    slack = np.sqrt(np.log(20) / 2) * (len(sp) ** -0.5 + n ** -0.5)
    k = int(np.argmin((qu + slack) / qp))
    return float(np.clip(qu[k] / qp[k], 0.02, 0.98))


def _over(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many scores reach each cut."""
    return len(scores) - np.searchsorted(np.sort(scores), cuts)


def fit_arrays(pos: np.ndarray, unl: np.ndarray, prior: float | None = None, moments=None, above=None) -> QualityModel:
    """Model from feature rows of positives and of unlabelled texts; no rows: every score is the prior.

    ``moments``, mean and deviation of the features, and ``above`` (see ``estimate_prior``; it gets rows as they
    are) describe all unlabelled rows where those given are a part of them.
    """
    both = np.vstack([pos, unl]) if len(pos) + len(unl) else np.zeros((1, N_FEATURES))
    mean, scale = moments or (both.mean(0), both.std(0) + 1e-3)
    if not len(pos) or not len(unl):
        w = np.zeros(1 + 2 * N_FEATURES)
        w[0] = 4.0 if prior is None else np.log(prior / (1 - prior))
        return QualityModel(mean, scale, w, prior or _sigmoid(np.array(4.0)).item())
    p, u = design(pos, mean, scale), design(unl, mean, scale)
    if prior is None:
        prior = estimate_prior(p, u, above and (lambda w, cuts: above(mean, scale, w, cuts)))

    def gradient(w):
        gp, gu = p @ w, u @ w
        good = -p.T @ _sigmoid(-gp) / len(p) * prior
        bad = u.T @ _sigmoid(gu) / len(u) - p.T @ _sigmoid(gp) / len(p) * prior
        below = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean() < 0
        return -bad if below else good + bad

    return QualityModel(mean, scale, _descend(gradient, p.shape[1]), prior)


@F.arrow_udf(ArrayType(DoubleType()))
def _features(text: pa.Array) -> pa.Array:
    return pa.array([features(t) for t in raw(text)], pa.list_(pa.float64()))


def _sample(rows: DataFrame, ids: DataFrame) -> np.ndarray:
    """Feature rows of the given (bounded) ids."""
    found = rows.join(F.broadcast(ids), "_id", "left_semi").collect()
    found.sort(key=lambda r: (r["_id"], r["x"]))
    return np.array([r["x"] for r in found]).reshape(-1, N_FEATURES)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, N_FEATURES)


def _summed(rows: DataFrame, size: int, of) -> np.ndarray:
    """``of(features)``, an array of ``size`` numbers that may be added up, over all rows."""
    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["k", "q"])

    out = np.zeros(size)
    for r in rows.select("x").mapInArrow(run, "k int, q double").groupBy("k").agg(F.sum("q").alias("q")).collect():
        out[r["k"]] = r["q"]
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_rows: int = 10_000) -> QualityModel:
    """Learn from rows whose crc32(id) mod 4 is not 2.

    Positives: ids labelled 1 and never 0. Unlabelled: ids of any documents. The gradient steps use at most
    ``max_rows`` ids of each kind; mean and deviation of the features, and the counts above the score cuts that give the
    class prior, are those of all unlabelled rows, whose features are written once. Rows without id, and
    labels without document, teach nothing.
    """
    def bounded(ids):
        return (ids.where(F.col("_id").isNotNull()).distinct()
                .orderBy(F.xxhash64("_id"), "_id").limit(max_rows))

    train = remainder(id_col, 4) != 2
    good = (labels.where(train & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
            .agg(F.min(label_col).alias("low")).where("low = 1").select("_id"))
    rows = cut_lineage(docs.where(train & F.col(id_col).isNotNull())
                       .select(F.col(id_col).alias("_id"), _features(F.col(text_col)).alias("x")))
    # positives are looked up among all documents' rows of these ids, which are training rows themselves
    pos, unl = _sample(rows, bounded(good)), _sample(rows, bounded(rows.select("_id")))
    k = N_FEATURES
    first = _summed(rows, k + 1, lambda x: np.r_[x.sum(0), len(x)])
    n = max(first[k], 1.0)
    mean = first[:k] / n
    scale = np.sqrt(_summed(rows, k, lambda x: ((x - mean) ** 2).sum(0)) / n) + 1e-3

    def above(mean, scale, w, cuts):
        found = _summed(rows, len(cuts) + 1, lambda x: np.r_[_over(design(x, mean, scale) @ w, cuts), len(x)])
        return found[-1], found[:-1]

    return fit_arrays(pos, unl, moments=(mean, scale), above=above)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text",
          out: str = "quality_score") -> DataFrame:
    """``docs`` with the probability ``out`` of being good text (0 to 1; a null text counts as empty).

    A column of that name is replaced; all rows, repeated ones too, and all other columns stay.
    """
    @F.arrow_udf("double")
    def value(text: pa.Array) -> pa.Array:
        forget()  # nothing is kept here, so nothing of the stage before stays either
        x = np.array([features(t) for t in raw(text)]).reshape(-1, N_FEATURES)
        return pa.array(model.score(x))

    return docs.withColumn(out, value(F.col(text_col)))
