"""Quality classifier by co-training.

Two logistic classifiers see a document from separate sides: one its text
(10 style values and 256 hashed word frequencies), one its page metadata
(language, source, length class).  Both start from labelled documents.  Then, in
each round, every unlabelled document of the corpus of which one view is
confident joins the other view's training set with that label.  Both are then
calibrated on labelled documents that neither has seen, and their calibrated
log-odds are added, less the prior's.

Fitting uses at most ``LABELLED`` labelled documents, the first by a hash of
their ids, and all unlabelled ones: a round's pseudo-labels enter as gradients,
summed over the whole corpus, of the loss at the view's weights, and the view
takes steps preconditioned by a bound of the labelled documents' Hessian.  What reaches
the driver is the labelled sample and, for each step, one sum for each weight
and class.  Labels beyond ``LABELLED`` aren't used, those documents count as
unlabelled.  Scoring covers all rows.

Empty and null texts score 0 and are rejected; null or new languages and
sources have buckets of their own; repeated rows score alike.  Repeated labels
of a document count as good only if all are.  If there are no labels of one
kind, every text that isn't empty is kept with the labels' share as its score,
even if all labels are bad.  Texts are taken whole whatever their length; a
score at the threshold is kept.  A class's only label both fits and calibrates.
``score`` keeps all columns of its input and replaces those of SCORES and
``kept``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches, scratch
from .words import Codes, Words

LABELLED, ROUNDS, STEPS = 6000, 4, 2
#: A view is confident beyond this probability, as it is and with the prior taken out.  Weight of the squared weights in the loss; added to the curvature's diagonal in a step.
CONFIDENT, PENALTY, DAMPING = 0.98, 1e-3, 1e-2
HASHED, THRESHOLD = 256, 0.5
TEXT_WIDTH, METADATA_WIDTH = 10 + HASHED, 16 + 64 + 20
SCORES = ("text_score", "metadata_score", "quality_score")
#: Rows, and bytes of their texts, that features are made of at a time: words and their hashes take some 25 times as much. Rows whose gradients are.
TEXTS, TEXT_BYTES, GRADIENTS = 200, 1 << 20, 1000
LOWER, UPPER = bytes(range(97, 123)), bytes(range(65, 91))


def text_features(texts: list[bytes], codes: Codes) -> np.ndarray:
    words = Words(texts, codes)
    n = np.maximum(1, words.lengths)
    style = np.zeros((len(texts), 8))
    for k, (text, own) in enumerate(zip(texts, words.split, strict=True)):
        if not own:
            continue
        size = len(text)
        upper = size - len(text.translate(None, UPPER))
        letters = upper + size - len(text.translate(None, LOWER))
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        style[k] = [
            math.log1p(len(own)),
            (size - len(own)) / len(own),
            upper / max(1, letters),
            (size - len(text.translate(None, b"0123456789"))) / size,
            math.sqrt((size - len(text.translate(None, b"#*$%&|<>!@~^_=+\\"))) / size),
            (size - len(text.translate(None, b".,;:?"))) / size,
            len(set(own)) / len(own),
            1 - len(set(lines)) / len(lines),
        ]
    again = (words.own[1:] == words.own[:-1]) & (words.text[1:] == words.text[:-1])
    doubled = np.bincount(words.text[1:][again], minlength=len(texts)) / n
    bucket = (words.form >> np.uint64(20)).astype(np.int64) & (HASHED - 1)
    hashed = np.bincount(words.text * HASHED + bucket, minlength=len(texts) * HASHED).reshape(-1, HASHED)
    return np.hstack([style, doubled[:, None], (words.repeat_words() / n)[:, None], np.sqrt(hashed / n[:, None])])


def metadata_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(METADATA_WIDTH)
    out[0 if lang is None else 1 + zlib.crc32(lang.encode()) % 15] = 1
    out[16 + (0 if source is None else 1 + zlib.crc32(source.encode()) % 63)] = 1
    out[80 + min(19, max(0, n_chars or 0).bit_length())] = 1
    return out


def inputs(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, lang, source, n_chars; null where ``df`` has no such column."""
    extra = [F.col(c).cast(k).alias(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in (("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), *extra)


# -- fitting, on the driver, on bounded samples ------------------------------


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 200) -> np.ndarray:
    """Weights (the last is the constant) by accelerated gradient descent; both classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    rate = 1 / (0.25 * float((weight[:, None] * x * x).sum()) + penalty)
    w = v = np.zeros(x.shape[1])
    for k in range(steps):
        grad = x.T @ (weight * (sigmoid(x @ v) - y)) + penalty * v
        new = v - rate * grad
        v, w = new + (k / (k + 3)) * (new - w), new
    return w


@dataclass
class View:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> View:
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        return cls(mean, scale, logistic((x - mean) / scale, y))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weights[:-1] + self.weights[-1]

    def gradient(self, x: np.ndarray, y: int) -> np.ndarray:
        """Number of rows of class ``y``, and the sum of their losses' gradients."""
        z = self.scaled(x)
        off = sigmoid(z @ self.weights[:-1] + self.weights[-1]) - y
        return np.concatenate([[len(x)], z.T @ off, [off.sum()]])

    def step(self, sums: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> None:
        """Down the gradient of the labelled rows and of ``sums`` (by class, as of ``gradient``); both classes weigh the same.

        The curvature used is an upper bound of the loss's, so that steps don't overshoot.
        """
        total, bound = PENALTY * self.weights, np.eye(len(self.weights)) * (PENALTY + DAMPING)
        for kind in (0, 1):
            z = np.hstack([self.scaled(x[y == kind]), np.ones(((y == kind).sum(), 1))])
            both = self.gradient(x[y == kind], kind) + sums[kind]
            total = total + both[1:] * (0.5 / both[0])
            bound += z.T @ z * (0.25 * 0.5 / len(z))
        self.weights = self.weights - np.linalg.solve(bound, total)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling with smoothed targets, by Newton's method; a step that doesn't lower the loss is halved."""
        z = self.raw(x)
        center, spread = float(z.mean()), max(float(z.std()), 1e-6)
        up, down = (y > 0.5).sum(), (y <= 0.5).sum()
        t = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
        a = np.stack([(z - center) / spread, np.ones(len(z))], 1)

        def loss(w: np.ndarray) -> float:
            v = a @ w
            return float((np.logaddexp(0, v) - t * v).sum() + 5e-4 * (w @ w))

        w = np.array([0.0, math.log((up + 1) / (down + 1))])
        for _ in range(50):
            p = sigmoid(a @ w)
            step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), a.T @ (p - t) + 1e-3 * w)
            size = 1.0
            while size > 1e-6 and loss(w - size * step) > loss(w):
                size /= 2
            w = w - size * step
            if size * np.abs(step).max() < 1e-9:
                break
        self.slope = max(0.0, float(w[0])) / spread
        self.shift = float(w[1]) - self.slope * center

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


@dataclass
class Model:
    text: View | None
    metadata: View | None
    prior: float

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None or self.metadata is None:
            p = np.full(len(text), self.prior)
            return p, p, p
        a, b = self.text.log_odds(text), self.metadata.log_odds(metadata)
        return sigmoid(a), sigmoid(b), sigmoid(a + b - math.log(self.prior / (1 - self.prior)))


def split(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to fit and to calibrate on: the last quarter of each class calibrates, one row at least; a class's only row does both."""
    fits, calibrates = [], []
    for kind in (0, 1):
        rows = np.flatnonzero(label == kind)
        cut = len(rows) - max(1, len(rows) // 4)
        fits.append(rows[: max(1, cut)])
        calibrates.append(rows[cut:])
    return np.sort(np.concatenate(fits)), np.sort(np.concatenate(calibrates))


def confident(judge: View, x: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that the view holds for class 0, and for class 1: both the probability and the evidence beyond the prior are to be that clear."""
    odds, least = judge.log_odds(x), math.log(CONFIDENT / (1 - CONFIDENT))
    evidence = odds - math.log(prior / (1 - prior))
    return np.maximum(odds, evidence) <= -least, np.minimum(odds, evidence) >= least


def pseudo_sums(views: list[View], judges: list[View], prior: float, sides: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums of gradients for view 0 of classes 0 and 1, then for view 1, over rows of which the other side's judge is confident."""
    out = []
    for k in (0, 1):
        out += [views[k].gradient(sides[k][sure], kind) for kind, sure in enumerate(confident(judges[1 - k], sides[1 - k], prior))]
    return np.concatenate(out)


def cotrain(text: np.ndarray, metadata: np.ndarray, label: np.ndarray, pool: Callable[[list[View], list[View], float], np.ndarray], rounds: int = ROUNDS) -> Model:
    """``label``: 0 or 1 for each row; the last quarter of each class is for calibration.  ``pool``: ``pseudo_sums`` over all unlabelled rows."""
    prior = float(label.mean()) if len(label) else 1.0
    if np.bincount(label, minlength=2).min() == 0:
        return Model(None, None, prior)
    fits, calibrates = split(label)
    sides = (text, metadata)
    views = [View.fit(side[fits], label[fits]) for side in sides]
    for _ in range(rounds):
        for view, side in zip(views, sides, strict=True):
            view.calibrate(side[calibrates], label[calibrates])
        judges = [replace(v) for v in views]
        for _ in range(STEPS):
            sums = pool(views, judges, prior)
            at = 0
            for view, side in zip(views, sides, strict=True):
                width = 1 + len(view.weights)
                view.step([sums[at : at + width], sums[at + width : at + 2 * width]], side[fits], label[fits])
                at += 2 * width
    for view, side in zip(views, sides, strict=True):
        view.calibrate(side[calibrates], label[calibrates])
    return Model(views[0], views[1], prior)


def packed(x: np.ndarray) -> list[bytes]:
    return [f.tobytes() for f in np.clip(x, -6e4, 6e4).astype("<f2")]


def unpacked(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<f2").reshape(len(rows), width).astype(float)


def features(df: DataFrame, labels: DataFrame, doc_id: str, text: str, good: str, labelled: int) -> DataFrame:
    """doc_id, label (null if none is used), x and m (both sides' features) of every row."""
    docs = inputs(df, doc_id, text)
    known = labels.filter(F.col(good).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.min((F.col(good) > 0).cast("int")).alias("label"))
    first = known.withColumn("h", order("doc_id")).orderBy("h", "doc_id").limit(labelled).select("doc_id", "label")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for b in batches.slices(it, TEXTS, TEXT_BYTES):
            x = packed(text_features([t or b"" for t in b.column(2).to_pylist()], codes))
            m = packed(np.array([metadata_features(*z) for z in zip(*(b.column(k).to_pylist() for k in (3, 4, 5)), strict=True)]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary()), pa.array(m, pa.binary())], ["doc_id", "label", "x", "m"])

    # `first` has at most `labelled` rows
    rows = docs.join(F.broadcast(first), "doc_id", "left").select("doc_id", "label", "text", "lang", "source", "n_chars")
    return batches.mapped(rows, run, "doc_id long, label int, x binary, m binary")


def order(doc_id: str) -> F.Column:
    return F.xxhash64(doc_id, F.lit("fit"))


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", good: str = "quality", labelled: int = LABELLED) -> Model:
    found = scratch.written(features(df, labels, doc_id, text, good, labelled))
    # one row for each of at most `labelled` ids, however often an id comes
    sample = found.filter("label IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("label", "x", "m")).alias("r"))
    rows = sample.select(order("doc_id").alias("h"), "doc_id", "r.label", "r.x", "r.m").orderBy("h", "doc_id").collect()
    x, m = (unpacked([bytes(r[k]) for r in rows], width) for k, width in (("x", TEXT_WIDTH), ("m", METADATA_WIDTH)))
    others = found.filter("label IS NULL").select("x", "m")

    def pool(views: list[View], judges: list[View], prior: float) -> np.ndarray:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * sum(1 + len(v.weights) for v in views))
            for b in batches.slices(it, GRADIENTS):
                total += pseudo_sums(views, judges, prior, (unpacked(b.column(0).to_pylist(), TEXT_WIDTH), unpacked(b.column(1).to_pylist(), METADATA_WIDTH)))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["j", "v"])

        sums = np.zeros(2 * sum(1 + len(v.weights) for v in views))
        for j, v in batches.mapped(others, run, "j int, v double").groupBy("j").agg(F.sum("v")).collect():  # a row for each weight and class
            sums[j] = v
        return sums

    model = cotrain(x, m, np.array([r["label"] for r in rows], np.int64), pool)
    scratch.drop(found)
    return model


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with the views' and the combined score, and whether to keep the row."""
    keep = [c for c in df.columns if c not in (*SCORES, "kept")]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(s, T.DoubleType()) for s in SCORES), T.StructField("kept", T.BooleanType())])
    at = [keep.index(c) if c in keep else None for c in (text, "lang", "source", "n_chars")]
    names, untrained = schema.names, model.text is None or model.metadata is None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for b in batches.slices(it, TEXTS, TEXT_BYTES):
            raw = b.column(at[0]).cast(pa.binary()).to_pylist()
            x = text_features([t or b"" for t in raw], codes)
            m = np.array([metadata_features(*z) for z in zip(*(b.column(k).to_pylist() if k is not None else [None] * b.num_rows for k in at[1:]), strict=True)])
            empty = np.array([not t or not t.strip() for t in raw])
            found = [np.where(empty, 0.0, s) for s in model.scores(x, m)]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, found), pa.array(~empty & (untrained | (found[2] >= threshold)))], names)

    return batches.mapped(df.select(*keep), run, schema)
