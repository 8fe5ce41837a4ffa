"""Language identification: averaged hashed subword embeddings under a linear softmax, fitted by SGD in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameledger.llm.arrow_text import slices, texts
from frameledger.llm.samples import labelled_ids, with_labels

UNKNOWN = "und"
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def subwords(raw: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subwords of 2 to 4 letters of all texts, and the text of each.

    Letters are lowered, everything else is a word boundary; a subword may begin or end at a boundary, not cross one.
    """
    points = [np.frombuffer(t.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32) for t in raw]
    gap = np.zeros(1, np.uint32)
    x = np.concatenate([gap, *(y for p in points for y in (p, gap))])
    row = np.repeat(np.arange(len(raw)), [len(p) + 1 for p in points])
    row = np.concatenate([row[:1], row]) if len(row) else np.zeros(1, np.int64)
    x = np.where(_letter_table()[x], x, 0).astype(np.uint32)
    solid = x > 0
    hashes, rows = [], []
    for n in (2, 3, 4):
        m = len(x) - n + 1
        if m <= 0:
            continue
        if n == 2:
            ok = solid[:m] | solid[1:]
        else:
            ok = np.logical_and.reduce([solid[i : m + i] for i in range(1, n - 1)])
        at = np.flatnonzero(ok)
        h = np.full(len(at), 2166136261 + n, np.uint32)
        for i in range(n):
            h = (h ^ x[at + i]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        hashes.append(h & np.uint32(buckets - 1))
        # The text of a letter in it: the second place, or of two the one that is a letter.
        rows.append(row[at + 1] if n > 2 else np.where(solid[at], row[at], row[at + 1]))
    return np.concatenate(hashes), np.concatenate(rows)


@dataclass
class LanguageModel:
    """Class names, per-bucket class weights (embedding times softmax weights), bias, temperature, least accepted score."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    report: dict = field(default_factory=dict)

    def scores(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated class probabilities of each text, and whether it has a letter at all."""
        buckets = len(self.weights)
        h, row = subwords(raw, buckets)
        count = np.bincount(row, minlength=len(raw)).astype(np.float64)
        total = np.stack([np.bincount(row, self.weights[h, c], len(raw)) for c in range(len(self.names))], 1)
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        return _softmax(z), count > 0


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, labels: DataFrame, label: str = "lang", sample: int = 2000, buckets: int = 1 << 15, dim: int = 16,
        epochs: int = 3, rate: float = 0.5, keep: float = 0.999, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> LanguageModel | None:
    """Fit on a bounded sample: at most `sample` labelled documents, whole, each with up to three of its lines as further,
    shorter examples. A fifth of the sample sets the temperature and the score below which a prediction is
    rejected, such that `keep` of the right predictions pass. None where no row is labelled.
    """
    ids = labelled_ids(labels, label, sample, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                out = []
                for t in texts(part.column("text")):
                    lines = [x for x in t.split(b"\n") if len(x.split()) >= 3]
                    example = []
                    for piece in [t, *lines[:: max(1, len(lines) // 3)][:3]]:
                        h, n = np.unique(subwords([piece], buckets)[0], return_counts=True)
                        example.append(h.astype("<u4").tobytes() + n.astype("<f4").tobytes())
                    out.append(example)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.list_(pa.binary()))], names=["doc_id", "x"])

    # `ids` has at most `sample` rows, so it can be sent to every executor.
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    rows = with_labels(chosen.mapInArrow(run, "doc_id bigint, x array<binary>"), ids, sample)
    names = sorted({r["label"] for r in rows})
    if not names:
        return None
    examples, held = [], []
    for i, r in enumerate(rows):
        for x in r["x"]:
            if x:                                   # bucket numbers, then their counts
                h, n = np.frombuffer(x[: len(x) // 2], "<u4"), np.frombuffer(x[len(x) // 2 :], "<f4")
                (held if i % 5 == 4 else examples).append((h, n / n.sum(), names.index(r["label"])))
    rng = np.random.default_rng(seed)
    embed, out, bias = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32), np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    steps, done = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            h, w, y = examples[k]
            lr = rate * (1 - done / steps)
            mean = w @ embed[h]
            p = _softmax((mean @ out + bias)[None])[0]
            p[y] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            embed[h] -= (lr * 20) * w[:, None] * back        # w is tiny: a text's step is spread over all its subwords
            done += 1
    model = LanguageModel(names, (embed @ out).astype(np.float32), bias)
    checked = held or examples
    z = np.stack([w @ model.weights[h] + bias for h, w, _ in checked]) if checked else np.zeros((0, len(names)))
    y = np.array([y for _, _, y in checked], int)
    if len(z):
        loss = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in np.geomspace(0.05, 20, 60)}
        model.temperature = float(min(loss, key=loss.get))
        p = _softmax(z / model.temperature)
        right = p.argmax(1) == y
        model.report = {"examples": len(examples), "held": len(y), "accuracy": float(right.mean())}
        if right.any():
            model.reject_below = float(min(0.5, np.quantile(p.max(1)[right], 1 - keep)))
    return model


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (calibrated probability of lang_pred), rejected.

    A text that is null or has no letter is `und` with score 0 and rejected; so is every text where there is no
    model. Repeated rows are kept, an empty table gives no rows, further columns are not carried.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                lang, score, out = predict(model, texts(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())],
                                                 names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def predict(model: LanguageModel | None, raw: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and rejection of each text."""
    if model is None or not raw:
        return [UNKNOWN] * len(raw), [0.0] * len(raw), [True] * len(raw)
    p, lettered = model.scores(raw)
    best, score = p.argmax(1), np.where(lettered, p.max(1), 0.0)
    lang = [model.names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())]
    return lang, score.tolist(), (~lettered | (score < model.reject_below)).tolist()
