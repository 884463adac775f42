"""Quality classifier by positive-unlabelled learning.

Trusted positives are the labelled rows of quality 1, the unlabelled sample is the text without a label, and
the class prior is estimated as the share of quality 1 among all labelled training rows.  The model minimises
the non-negative unbiased risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

with the logistic loss: where the second part falls below zero, which only overfitting does, the step is taken
against it.  The model is additive: each feature of a text is cut into quantile bins with a weight each.

Its margin is then calibrated by a logistic curve (slope and offset) on labelled training rows of either class,
so that a score is the chance of label 1.

Features (of whole texts) are shares of character classes, repetition of words, word triples and lines, word
and line lengths and compressibility; neither ids, labels, language nor source are among them.  They are
computed once for all texts and written to the shared folder.  Training reads up to `positives` and `unlabelled`
rows of them, those with the smallest hashes of their ids; these bounds are parameters.

Edge cases: null text is empty and scored like any text; without a trusted positive every score is 0.5;
without unlabelled text the labelled rows, stripped of their labels, stand in for it; rows of labels without a
document, or with a null quality or doc_id, teach nothing; repeated rows are scored each; a doc_id labelled
twice counts twice.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import doc_texts, materialize

WORD = re.compile(r"\S+")
BINS = 24
POSITIVES = 10_000
UNLABELLED = 20_000
THRESHOLD = 0.7
SAMPLE_CHARS = 1 << 20
#: Character classes of ASCII bytes; other bytes are in none.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", ".,;:?'\"()-", "!", "*#$%&@^~+", "|", "<>{}[]=\\/_`")
CLASS_OF = np.full(256, len(CLASSES), dtype=np.uint8)
for _k, _chars in enumerate(CLASSES):
    CLASS_OF[np.frombuffer(_chars.encode(), np.uint8)] = _k
N_FEATURES = len(CLASSES) + 10


def share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def features(text: str) -> list[float]:
    """The features of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(CLASS_OF[np.frombuffer(data, np.uint8)], minlength=len(CLASSES) + 1)
    words = WORD.findall(text)
    distinct = len(set(words))
    triples = len(words) - 2
    lines = [x for x in text.split("\n") if x]
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(data[i : i + SAMPLE_CHARS])) for i in range(0, len(data), SAMPLE_CHARS)) + len(packer.flush())
    shouted = sum(map(str.isupper, words))
    return [
        *(counts[: len(CLASSES)] / max(1, len(data))).tolist(),
        math.log1p(len(text)),
        share(counts[0], counts[0] + counts[1]),
        share(sum(map(len, words)), len(words)),
        share(distinct, len(words)),
        share(sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words)),
        share(len(set(zip(words, words[1:], words[2:], strict=False))), triples) if triples > 0 else 1.0,
        share(len(set(lines)), len(lines)) if lines else 1.0,
        math.log1p(share(len(text), len(lines))),
        share(packed, len(data)),
        share(shouted, len(words)),
    ]


def feature_table(documents: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return materialize(doc_texts(documents).mapInArrow(run, "doc_id long, x array<double>"), "features")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class AdditiveModel:
    """A weight for each quantile bin of each feature."""

    def __init__(self, edges: list[np.ndarray], bins: int = BINS):
        self.edges, self.bins = edges, bins
        self.weights, self.bias = np.zeros((len(edges), bins)), 0.0
        self.slope, self.offset = 1.0, 0.0

    @classmethod
    def over(cls, x: np.ndarray, bins: int = BINS) -> AdditiveModel:
        """With the quantiles of x as edges; equal ones count once."""
        return cls([np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T], bins)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, column, side="left") for e, column in zip(self.edges, x.T, strict=True)], axis=1)

    def margin(self, cells: np.ndarray) -> np.ndarray:
        return self.weights[np.arange(cells.shape[1]), cells].sum(axis=1) + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margin(self.cells(x)) + self.offset)

    def calibrate(self, x: np.ndarray, label: np.ndarray, steps: int = 50) -> None:
        """Slope and offset by Newton steps on the logistic loss, with Platt's targets."""
        n_1, n_0 = int(label.sum()), int((1 - label).sum())
        if not n_1 or not n_0:
            return
        target = np.where(label == 1, (n_1 + 1) / (n_1 + 2), 1 / (n_0 + 2))
        design = np.stack((self.margin(self.cells(x)), np.ones(len(x))), axis=1)
        beta = np.array([1.0, 0.0])
        for _ in range(steps):
            p = sigmoid(design @ beta)
            curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
            move = np.linalg.solve(curve, design.T @ (p - target))
            beta -= np.clip(move, -2, 2)
        if beta[0] > 0:
            self.slope, self.offset = float(beta[0]), float(beta[1])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05) -> AdditiveModel:
    """Minimise the non-negative unbiased risk by Adam over all rows."""
    model = AdditiveModel.over(np.concatenate((positive, unlabelled)))
    cells_p, cells_u = model.cells(positive), model.cells(unlabelled)
    f = cells_p.shape[1]
    flat_p, flat_u = (c + np.arange(f) * model.bins for c in (cells_p, cells_u))
    ridge = max(1e-3, 0.5 / len(positive))
    moment, square = np.zeros(f * model.bins + 1), np.zeros(f * model.bins + 1)
    for step in range(1, steps + 1):
        s_p, s_u = sigmoid(model.margin(cells_p)), sigmoid(model.margin(cells_u))
        negative = -np.log1p(-np.minimum(s_u, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(s_p, 1 - 1e-12)).mean()
        # Slopes of the risk in each row's margin.
        fault_p, fault_u = -prior * s_p / len(s_p), s_u / len(s_u)
        if negative >= 0:
            slope_p, slope_u = fault_p - prior * (1 - s_p) / len(s_p), fault_u
        else:
            slope_p, slope_u = -fault_p, -fault_u
        slope = np.empty(f * model.bins + 1)
        slope[:-1] = np.bincount(np.concatenate((flat_p.ravel(), flat_u.ravel())), np.concatenate((np.repeat(slope_p, f), np.repeat(slope_u, f))), f * model.bins)
        slope[:-1] += ridge * model.weights.ravel()
        slope[-1] = slope_p.sum() + slope_u.sum()
        moment = 0.9 * moment + 0.1 * slope
        square = 0.999 * square + 0.001 * slope * slope
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        model.weights -= move[:-1].reshape(f, model.bins)
        model.bias -= move[-1]
    return model


def learn(table: DataFrame, labels: DataFrame, teaches: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> AdditiveModel | None:
    """A model from the rows of labels where `teaches` (of doc_id) holds; at most so many rows reach the driver."""
    known = labels.where(teaches & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    prior = known.agg(F.avg("quality")).first()[0]
    if not prior:
        return None
    mine = table.where(teaches & F.col("doc_id").isNotNull())
    first = lambda rows, n: np.array([r.x for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("x").collect()]).reshape(-1, N_FEATURES)
    trusted, doubtful = (first(mine.join(known.where(F.col("quality") == q), "doc_id"), positives) for q in (1, 0))
    if not len(trusted):
        return None
    rest = first(mine.join(labels.select("doc_id"), "doc_id", "left_anti"), unlabelled)
    if not len(rest):
        rest = np.concatenate((trusted, doubtful))
    model = fit(trusted, rest, min(float(prior), 0.99))
    model.calibrate(np.concatenate((trusted, doubtful)), np.repeat([1, 0], [len(trusted), len(doubtful)]))
    return model


def score(table: DataFrame, model: AdditiveModel | None) -> DataFrame:
    """(doc_id, score) of every row of a feature table."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, N_FEATURES)
            found = shared.value.scores(x) if shared.value is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    return table.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
