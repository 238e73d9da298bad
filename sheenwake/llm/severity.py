"""Toxicity severity by cumulative-link ordinal regression (operator 5).

Grades run from 0 (none) to 3. The model is P(grade <= k) = logistic(threshold[k] - w . x): all thresholds share
the weights w, and the thresholds are kept in order. x holds log(1 + count) of dictionary words, a sparse vector.
The expected severity is the sum of k * P(grade = k).

Labels say only toxic or not, so training grades are derived: a toxic text's grade grows with the number of its
words that mark toxic texts (found in ``LIFT`` times as large a share of toxic as of other training texts):
one or none is 1, up to three 2, more 3. The dictionary is the words that tell the two kinds apart best by their
chi-square value, at most ``MAX_WORDS``; other words have no weight, so long clean texts gather no score.
"""
from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, remainder

GRADES = 4
MAX_ROWS = 12_000
MAX_WORDS = 2_048
LEAST_DOCS = 8
LEAST_CHI = 40.0
LIFT = 20
EDGES = b".,;:!?\"'()[]{}<>|#$%&*+-=/\\@^_`~"


def words(text: bytes) -> list[bytes]:
    """Lower-case words without marks at their ends."""
    return [w for w in (x.strip(EDGES) for x in text.lower().split()) if w]


@dataclass
class SeverityModel:
    """Dictionary words with their weights, and the ordered thresholds."""

    weights: dict[bytes, float]
    thresholds: np.ndarray

    def probabilities(self, counts: list[dict[bytes, int]]) -> np.ndarray:
        """Rows of grade probabilities for the counts of dictionary words in texts."""
        x = np.array([sum(self.weights[w] * np.log1p(n) for w, n in c.items()) for c in counts])
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - x[:, None], -30, 30)))
        below = np.hstack([np.zeros((len(x), 1)), below, np.ones((len(x), 1))])
        return np.diff(below, axis=1)


def derive_grades(counts: list[Counter], toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to 3 from toxic flags and the number of words that mark toxic texts."""
    n1, n0 = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    d1, d0 = Counter(), Counter()
    for c, t in zip(counts, toxic):
        (d1 if t else d0).update(c.keys())
    marks = {w for w, n in d1.items() if n >= LEAST_DOCS and n / n1 >= LIFT * (d0[w] + 0.5) / n0}
    hits = np.array([sum(n for w, n in c.items() if w in marks) for c in counts])
    return np.where(toxic, 1 + (hits >= 2) + (hits >= 4), 0)


def choose_words(counts: list[Counter], toxic: np.ndarray, most: int = MAX_WORDS,
                 least_chi: float = LEAST_CHI) -> list[bytes]:
    """Words by chi-square of presence against toxicity; values under 40 are chance among so many words."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    d1, d0 = Counter(), Counter()
    for c, t in zip(counts, toxic):
        (d1 if t else d0).update(c.keys())
    scored, n = [], n1 + n0
    for w in d1.keys() | d0.keys():
        a, b = d1[w], d0[w]
        if a + b < LEAST_DOCS or a + b == n or not n1 or not n0:
            continue
        chi = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b) * (n - a - b) * n1 * n0)
        if chi >= least_chi:
            scored.append((-chi, w))
    return [w for _, w in sorted(scored)[:most]]


def fit_rows(texts: list[Counter], toxic: list[bool], steps: int = 400, rate: float = 0.05,
             decay: float = 1e-3, max_words: int = MAX_WORDS, least_chi: float = LEAST_CHI) -> SeverityModel:
    """Model from word counts and toxic flags, by Adam on the log-likelihood; no toxic row: severity near 0."""
    flags = np.array(toxic, bool)
    if not flags.any() or flags.all():
        at = np.array([6.0, 7.0, 8.0]) * (1 if not flags.any() else -1)
        return SeverityModel({}, np.sort(at))
    grades = derive_grades(texts, flags)
    chosen = choose_words(texts, flags, max_words, least_chi)
    number = {w: k for k, w in enumerate(chosen)}
    row, col, val = [], [], []
    for r, c in enumerate(texts):
        for w, n in c.items():
            if w in number:
                row.append(r), col.append(number[w]), val.append(np.log1p(n))
    row, col, val = np.array(row, int), np.array(col, int), np.array(val, float)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / len(grades), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    # thresholds are the first one and the logs of the gaps between them, so they stay in order
    theta = np.r_[np.zeros(len(chosen)), start[0], np.log(np.maximum(np.diff(start), 1e-2))]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = len(chosen)
    balance = np.where(flags, 0.5 / flags.mean(), 0.5 / (1 - flags.mean()))
    for t in range(1, steps + 1):
        at = theta[k] + np.r_[0, np.cumsum(np.exp(theta[k + 1:]))]
        x = np.bincount(row, theta[col] * val, minlength=len(texts)) if len(row) else np.zeros(len(texts))
        edge = np.r_[-np.inf, at, np.inf]
        hi, lo = (1 / (1 + np.exp(-np.clip(edge[grades + s] - x, -30, 30))) for s in (1, 0))
        hi[grades == GRADES - 1], lo[grades == 0] = 1.0, 0.0
        p = np.maximum(hi - lo, 1e-9)
        dh, dl = hi * (1 - hi) / p * balance, lo * (1 - lo) / p * balance
        gx = (dh - dl) / len(texts)
        g_at = np.array([(dl[grades == j + 1].sum() - dh[grades == j].sum()) / len(texts) for j in range(GRADES - 1)])
        gaps = np.exp(theta[k + 1:])
        g = np.r_[np.bincount(col, gx[row] * val, minlength=k) if len(row) else np.zeros(k),
                  g_at.sum(), [g_at[j + 1:].sum() * gaps[j] for j in range(GRADES - 2)]]
        g[:k] += decay * theta[:k]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    at = theta[k] + np.r_[0, np.cumsum(np.exp(theta[k + 1:]))]
    return SeverityModel({w: float(theta[j]) for w, j in number.items()}, at)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS,
        least_chi: float = LEAST_CHI) -> SeverityModel:
    """Learn from at most ``max_rows`` labelled texts whose crc32(id) mod 4 is not 2, in the order of a hash.

    Half of them are toxic ones, as far as there are. An id labelled both ways counts as toxic; null labels, null
    ids and labels without a document teach nothing; with no labels at all every severity is near 0. The dictionary
    has at most ``max_words`` words, those of the highest chi-square from ``least_chi`` on: a model has a bounded size.
    """
    known = (labels.where((remainder(id_col, 4) != 2) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_toxic")))
    part = [known.where(F.col("_toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(max_rows // 2) for k in (0, 1)]
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(part[0].union(part[1])), "_id"))

    def run(batches):
        for batch in batches:
            counts = [Counter(words(t)) for t in raw(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                 pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], ["toxic", "words", "counts"])

    found = rows.select("_text", F.col("_toxic").cast("int")).mapInArrow(
        run, "toxic int, words array<binary>, counts array<int>").toLocalIterator()
    texts, toxic = [], []
    for r in found:
        texts.append(Counter(dict(zip(map(bytes, r["words"]), r["counts"]))))
        toxic.append(r["toxic"] == 1)
    return fit_rows(texts, toxic, max_words=max_words, least_chi=least_chi)


def score(docs: DataFrame, model: SeverityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with expected_severity (0 to 3), toxic_probability (of grade 1 or more) and grade (the likeliest).

    Every whole text is read; a null or empty one holds no dictionary word. Columns of these names are replaced;
    all rows and other columns stay.
    """
    @F.arrow_udf("array<double>")
    def grades(text: pa.Array) -> pa.Array:
        known, counts = model.weights, []
        for t in raw(text):
            c: dict[bytes, int] = {}
            for w in t.lower().split():
                w = w.strip(EDGES)
                if w in known:
                    c[w] = c.get(w, 0) + 1
            counts.append(c)
        return pa.array(model.probabilities(counts).tolist() if counts else [], pa.list_(pa.float64()))

    p = F.col("_severity")
    expected = sum((p[k] * k for k in range(2, GRADES)), p[1])
    best = F.array_position(p, F.array_max(p)).cast("int") - 1
    return (docs.withColumn("_severity", grades(F.col(text_col)))
            .withColumns({"expected_severity": expected, "toxic_probability": 1 - p[0], "grade": best}).drop("_severity"))
