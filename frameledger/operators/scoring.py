"""User-supplied models and mask proposers, run batch by batch on the executors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from frameledger.constants import SKIN_LOOSE, SKIN_TIGHT
from frameledger.operators import frames as K


def score(df: DataFrame, load: Callable, predict: Callable, schema: str) -> DataFrame:
    """Apply `predict(model, batch)` to Arrow batches; `load()` runs once per task.

    `load` and `predict` work on pandas frames; only the columns of `df` are sent to Python.
    """
    def run(batches):
        model = load()
        for pdf in batches:
            yield predict(model, pdf)

    return df.mapInPandas(run, schema)


def level_masks(f: K.Frames, levels: tuple[int, ...] = (220, 128, 90, 60, 30)) -> np.ndarray:
    """A ladder of candidate masks (n, rungs, h, w): what is at least as bright as each level."""
    return np.stack([f.mask >= t for t in levels], 1)


def skin_masks(f: K.Frames) -> np.ndarray:
    """Chroma bands from tight to loose, each also opened and closed."""
    bands = [np.where(K.skin(f.rgb, b), 255, 0) for b in (SKIN_TIGHT, SKIN_LOOSE)]
    return np.stack([m >= 128 for b in bands for m in (b, K.closed(K.opened(b, 3), 3))], 1)


#: Proposers by name: each takes a slice of frames and gives a ladder of candidate masks.
BACKENDS: dict[str, Callable[[K.Frames], np.ndarray]] = {"levels": level_masks, "skin": skin_masks}
CANDIDATES = "frame_id bigint, rk int, frac double, x1 int, y1 int, x2 int, y2 int, mask binary"


def propose(frames: DataFrame, backend: str, backends: dict[str, Callable[[K.Frames], np.ndarray]] | None = None) -> DataFrame:
    """Candidate masks of every frame, a row a rung: rank, share of the frame, box (null without foreground) and mask.

    The backend runs inside the tasks, slice by slice; an unknown name is an error. What picks one is up to the caller
    (`picking.ladder_pick`, `picking.first_below`).
    """
    known = {**BACKENDS, **(backends or {})}
    if backend not in known:
        raise ValueError(f"unknown backend {backend!r}; known: {sorted(known)}")
    make = known[backend]

    def work(f: K.Frames) -> dict[str, object]:
        masks = make(f)
        n, rungs = masks.shape[:2]
        flat = np.where(masks.reshape(n * rungs, f.h, f.w), 255, 0).astype(np.uint8)
        box, some = K.mask_boxes(flat)
        return {"frame_id": np.repeat(f.ids, rungs), "rk": np.tile(np.arange(rungs, dtype=np.int32), n), "frac": (flat > 0).mean((1, 2)),
                **{c: pa.array(box[:, i].astype(np.int32), mask=~some) for i, c in enumerate(("x1", "y1", "x2", "y2"))}, "mask": pa.array([m.tobytes() for m in flat], pa.binary())}

    return K.over(frames, work, CANDIDATES)
