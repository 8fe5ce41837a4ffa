"""Quality by Bradley-Terry ranking: document scores from preference pairs, cut at a score quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameledger.llm.arrow_text import slices, texts
from frameledger.llm.samples import labelled_ids, with_labels

#: Byte classes whose share of a text is a feature.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"#$%&*@^~", b"|\\/_", b".,;:", b"+=<>[]{}()", b"'\"`-", b" ", b"\n", b"\t\r", bytes(range(128, 256))]
_CLASS_OF = np.full(256, len(_CLASSES))
for _i, _c in enumerate(_CLASSES):
    _CLASS_OF[list(_c)] = _i
WIDTH = 2 * (len(_CLASSES) + 1) + 11


def features(text: bytes) -> np.ndarray:
    """A fixed-width description of a whole text: character classes, words, lines and repetition. Empty texts are zeros."""
    x = np.zeros(WIDTH)
    words = text.split()
    if not words:
        return x
    share = np.bincount(_CLASS_OF[np.frombuffer(text, np.uint8)], minlength=len(_CLASSES) + 1) / len(text)
    k = len(share)
    x[:k], x[k : 2 * k] = share, np.sqrt(share)
    n = len(words)
    lines = [y for y in text.split(b"\n") if y.strip()]
    threes = n - 2
    x[2 * k :] = [
        np.log1p(n), np.log1p(len(text)), sum(map(len, words)) / n / 10, len(set(words)) / n,
        len(set(zip(words, words[1:], words[2:]))) / threes if threes > 0 else 1.0,
        len(set(lines)) / len(lines), np.log1p(len(lines)), np.log1p(n / len(lines)), max(map(len, words)) ** 0.5 / 5,
        sum(map(bytes.isupper, words)) / n, sum(map(bytes.isalpha, words)) / n,
    ]
    return x


@dataclass
class QualityModel:
    """score(x) = sigmoid(slope * (weights . (x - mean) / spread - cut))."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.rank(x) - self.cut), -40, 40)))


def _feature_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([features(t).tolist() for t in texts(part.column("text"))], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 6000, pairs: int = 40_000, ridge: float = 1e-3, seed: int = 11,
        id_col: str = "doc_id", text_col: str = "text") -> QualityModel | None:
    """Fit on a bounded sample of at most `sample` labelled documents (labels 0 and 1).

    A preference pair is a document of label 1 over one of label 0; `pairs` of them are drawn. The logistic loss of
    their feature differences, with a ridge, is minimised by Newton steps. The cut is the score quantile at which the
    sample's share of label 1 lies above; the slope fits the sample's labels. None unless both labels occur.
    """
    ids = labelled_ids(labels, label, sample, id_col)
    # `ids` has at most `sample` rows, so it can be sent to every executor.
    rows = with_labels(_feature_rows(docs.join(F.broadcast(ids.select(F.col("doc_id").alias(id_col))), id_col, "left_semi"), id_col, text_col), ids, sample)
    x, y = np.array([r["x"] for r in rows]).reshape(-1, WIDTH), np.array([int(r["label"]) for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(np.flatnonzero(y == 1), pairs)] - z[rng.choice(np.flatnonzero(y == 0), pairs)]
    w = np.zeros(WIDTH)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        slope = d.T @ (p - 1) / pairs + ridge * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(WIDTH), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    rank = z @ w
    cut = float(np.quantile(rank, 1 - y.mean()))
    slope = min(np.geomspace(0.01, 100, 80), key=lambda a: np.logaddexp(0, np.where(y == 1, -1, 1) * a * (rank - cut)).mean())
    return QualityModel(mean, spread, w, cut, float(slope))


def rate(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1), rank (the ranking score), predicted (1 if score >= 0.5).

    Null texts count as empty and are scored like any other; without a model every score is 0.5. Repeated rows are
    kept, an empty table gives no rows, further columns are not carried.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.array([features(t) for t in texts(part.column("text"))]).reshape(-1, WIDTH)
                score = model.score(x) if model else np.full(len(x), 0.5)
                rank = model.rank(x) if model else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(rank), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "rank", "predicted"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double, rank double, predicted int")
