"""Parameters of batch image transforms, drawn per frame as columns, and the transforms over frame rows.

Random values come from hashes of the frame's id, so they depend neither on partitioning nor on retries. Where a frame
needs many (noise, kernels), one hash seeds a counter-based stream. The pixels are worked in operators/frames.py.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from frameledger.constants import (
    CAMERA_STAGES, HUE_GB, HUE_GG, HUE_GR, LUM_B, LUM_G, LUM_R, PHOTOMETRIC_MODES)
from frameledger.functions.numeric import clip, hash_long, normal, uniform, uniform_between
from frameledger.operators import frames as K

C = F.col
RGB = ("r", "g", "b")
LUM = (LUM_R, LUM_G, LUM_B)


# -- colour maps: 3x3 of columns or numbers, optional bias ------------------------------------

def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def saturation_matrix(s) -> list[list[Column]]:
    """Scale chroma about the luma axis."""
    s = _col(s)
    rest = F.lit(1.0) - s
    return [[F.lit(LUM[j]) * rest + (s if i == j else F.lit(0.0)) for j in range(3)] for i in range(3)]


def hue_matrix(turns) -> list[list[Column]]:
    """Rotate the chroma plane by `turns` of a full circle."""
    angle = _col(turns) * (2.0 * math.pi)
    c, s = F.cos(angle), F.sin(angle)
    sine = [[-LUM_R, -LUM_G, 1 - LUM_B], [HUE_GR, HUE_GG, HUE_GB], [-(1 - LUM_R), LUM_G, LUM_B]]
    return [[F.lit(LUM[j]) + c * ((1.0 if i == j else 0.0) - LUM[j]) + s * sine[i][j] for j in range(3)] for i in range(3)]


def diagonal(*v) -> list[list[Column]]:
    return [[_col(v[i]) if i == j else F.lit(0.0) for j in range(3)] for i in range(3)]


def store_matrix(frames: DataFrame, name: str, m) -> DataFrame:
    """Materialise a matrix as nine frame columns, so a product does not repeat expressions."""
    return frames.withColumns({f"{name}{i}{j}": m[i][j] for i in range(3) for j in range(3)})


def stored(name: str) -> list[list[Column]]:
    return [[C(f"{name}{i}{j}") for j in range(3)] for i in range(3)]


def matmul(a, b) -> list[list[Column]]:
    return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]


# -- jitter -------------------------------------------------------------------------------------

def jitter_params(frames: DataFrame, seed, strength: float = 1.0, brightness: float = 0.4, contrast: float = 0.4,
                  saturation: float = 0.4, hue: float = 0.1) -> DataFrame:
    """Per frame: the four factors, their hashed order, and the composed map M x + grey * beta."""
    key = C("frame_id")

    def draw(tag, half):
        return F.lit(1.0 if tag != "hue" else 0.0) + F.lit(strength) * uniform_between(-half, half, f"{seed}-{tag}", key)

    drawn = frames.withColumns({"jb": draw("brightness", brightness), "jc": draw("contrast", contrast),
                                "js": draw("saturation", saturation), "jh": draw("hue", hue),
                                **{f"jo{i}": uniform(f"{seed}-order{i}", key) for i in range(4)}})
    ranks = {f"jr{i}": sum(F.when(C(f"jo{k}") < C(f"jo{i}"), 1).otherwise(0) for k in range(4)) for i in range(4)}
    out = drawn.withColumns(ranks)
    ops = [diagonal(C("jb"), C("jb"), C("jb")), diagonal(C("jc"), C("jc"), C("jc")),
           saturation_matrix(C("js")), hue_matrix(C("jh"))]
    out = store_matrix(out, "jm", diagonal(1.0, 1.0, 1.0)).withColumns({f"jbeta{i}": F.lit(0.0) for i in range(3)})
    for step in range(4):
        def pick(cells):
            return F.coalesce(*[F.when(C(f"jr{k}") == step, cells[k]) for k in range(4)])

        m = [[pick([op[i][j] for op in ops]) for j in range(3)] for i in range(3)]
        add = F.when(C("jr1") == step, F.lit(1.0) - C("jc")).otherwise(F.lit(0.0))
        out = store_matrix(out, "jn", m)
        n, beta = stored("jn"), [C(f"jbeta{i}") for i in range(3)]
        prod = matmul(n, stored("jm"))
        moved = {f"jbeta{i}": n[i][0] * beta[0] + n[i][1] * beta[1] + n[i][2] * beta[2] + add for i in range(3)}
        out = out.withColumns({**{f"jm{i}{j}": prod[i][j] for i in range(3) for j in range(3)}, **moved})
    keep = [f"jm{i}{j}" for i in range(3) for j in range(3)] + [f"jbeta{i}" for i in range(3)]
    return out.select(*frames.columns, *keep)


# -- camera stages ------------------------------------------------------------------------------

def camera_params(frames: DataFrame, seed, strength: float = 1.0, stages=CAMERA_STAGES) -> DataFrame:
    """Per frame: every random value of the camera chain. Stages switched off get their identity."""
    bad = set(stages) - set(CAMERA_STAGES)
    if bad:
        raise ValueError(f"not offered as camera stages: {', '.join(sorted(bad))}")
    key, s, on = C("frame_id"), float(strength), set(stages)

    def u(tag, lo, hi):
        return uniform_between(lo, hi, f"{seed}-{tag}", key)

    one = F.lit(1.0)
    gain = {c: one + F.lit(s) * (u(f"wb{c}", 0.80, 1.25) - one) if "wb" in on else one for c in ("r", "b")}
    out = frames.withColumns({"wbr": gain["r"], "wbb": gain["b"],
                              "ev": F.pow(F.lit(2.0), F.lit(s) * u("ev", -0.6, 0.6)) if "exposure" in on else one})
    if "ccm" in on:
        raw = {f"cc{i}{j}": F.lit(1.0 if i == j else 0.0) + F.lit(0.05 * s) * normal(f"{seed}-ccm{i}{j}", key)
               for i in range(3) for j in range(3)}
        out = out.withColumns(raw)
        rows = [C(f"cc{i}0") + C(f"cc{i}1") + C(f"cc{i}2") for i in range(3)]
        ccm = [[C(f"cc{i}{j}") / F.when(F.abs(rows[i]) < 1e-3, one).otherwise(rows[i]) for j in range(3)] for i in range(3)]
    else:
        ccm = diagonal(1.0, 1.0, 1.0)
    white = (C("wbr"), one, C("wbb"))
    lin = [[ccm[i][j] * white[j] * C("ev") for j in range(3)] for i in range(3)]
    sat = one + F.lit(s) * (u("sat", 0.6, 1.3) - one)
    out = store_matrix(out, "lin", lin)
    noisy = (uniform(f"{seed}-noise", key) < 0.5) if "noise" in on else F.lit(False)
    out = out.withColumns({
        "na": F.when(noisy, F.exp(u("na", math.log(1e-5), math.log(1e-3))) * s).otherwise(0.0),
        "nb": F.when(noisy, F.exp(u("nb", math.log(1e-6), math.log(1e-4))) * s).otherwise(0.0),
        "gamma": F.lit(2.2) + F.lit(s) * (u("gamma", 1.8, 2.6) - 2.2) if "gamma" in on else F.lit(2.2)})
    raw = [clip(F.lit(k / 4.0) + F.lit(s) * u(f"tone{k}", -0.10, 0.10), 0.0, 1.0) for k in range(5)]
    out = out.withColumns({f"tk{k}": raw[k] if "tone" in on else F.lit(k / 4.0) for k in range(5)})
    level = C("tk0")
    knots = [level]
    for k in range(1, 5):
        level = level + F.greatest(C(f"tk{k}") - C(f"tk{k - 1}"), F.lit(0.0))
        knots.append(clip(level, 0.0, 1.0))
    out = out.withColumns({f"ty{k}": v for k, v in enumerate(knots)})
    if "satihue" in on:
        out = store_matrix(out, "sh0", saturation_matrix(sat))
        out = store_matrix(out, "sh1", hue_matrix(F.lit(s) * u("hue", -0.05, 0.05)))
        out = store_matrix(out, "sh", matmul(stored("sh1"), stored("sh0")))
    blur = uniform(f"{seed}-side", key) < 0.5
    sigma = F.when(blur, F.lit(0.3) + F.lit(s) * u("blur", 0.1, 1.2)).otherwise(F.lit(0.5) + F.lit(s) * u("unsharp", 0.0, 1.0))
    amount = F.when(blur, F.lit(None).cast("double")).otherwise(F.lit(s) * u("amount", 0.3, 1.5))
    use = "sharpblur" in on
    shift_on = (uniform(f"{seed}-chroma", key) < 0.2) if "chroma" in on else F.lit(False)
    resampled = (uniform(f"{seed}-resample", key) < 0.5) if "resample" in on else F.lit(False)
    factor = F.greatest(one, one + F.lit(s) * (u("factor", 1.0, 2.0) - one))

    def unit_step(tag):
        return F.when(shift_on, F.floor(uniform(f"{seed}-{tag}", key) * 3).cast("int") - 1).otherwise(0)

    out = out.withColumns({"sigma": sigma if use else F.lit(None).cast("double"), "amount": amount if use else F.lit(None).cast("double"),
                           "dx": unit_step("dx"), "dy": unit_step("dy"), "factor": F.when(resampled, factor).otherwise(one),
                           **{f"nk{c}": hash_long(f"{seed}-nk{c}", key) for c in range(3)}})
    keep = ([f"lin{i}{j}" for i in range(3) for j in range(3)] + ["na", "nb", "gamma"] + [f"ty{k}" for k in range(5)]
            + ["sigma", "amount", "dx", "dy", "factor", "nk0", "nk1", "nk2"]
            + ([f"sh{i}{j}" for i in range(3) for j in range(3)] if "satihue" in on else []))
    return out.select(*frames.columns, *keep)


def tone_value(v: Column, knots: list[Column]) -> Column:
    """Piecewise-linear curve over evenly spaced knots 0..1."""
    n = len(knots) - 1
    i = F.least(F.floor(v * n), F.lit(n - 1)).cast("int")
    arr = F.array(*knots)
    lo, hi = F.element_at(arr, i + 1), F.element_at(arr, i + 2)
    return lo + (hi - lo) * (v * n - i)


# -- geometry -----------------------------------------------------------------------------------

def flip_box(box, w, when: Column) -> list[Column]:
    return [F.when(when, F.lit(w) - box[2]).otherwise(box[0]), box[1],
            F.when(when, F.lit(w) - box[0]).otherwise(box[2]), box[3]]


def crop_proposals(frames: DataFrame, seed, w: int, h: int, attempts: int = 10, scale=(0.5, 1.0), ratio=(3 / 4, 4 / 3)) -> DataFrame:
    """Array `props` of hashed crop proposals per frame; those that do not fit are dropped."""
    f = C("frame_id")

    def shape(k):
        area = uniform_between(scale[0], scale[1], f"{seed}-area", f, k) * float(w * h)
        ar = F.exp(uniform_between(math.log(ratio[0]), math.log(ratio[1]), f"{seed}-ratio", f, k))
        return F.struct(k.alias("attempt"), F.bround(F.sqrt(area * ar)).cast("int").alias("cw"), F.bround(F.sqrt(area / ar)).cast("int").alias("ch"))

    def place(p):
        k, cw, ch = p["attempt"], p["cw"], p["ch"]
        return F.struct(k.alias("attempt"), cw.alias("cw"), ch.alias("ch"),
                        F.floor(uniform(f"{seed}-x", f, k) * (F.lit(w + 1) - cw)).cast("int").alias("x0"),
                        F.floor(uniform(f"{seed}-y", f, k) * (F.lit(h + 1) - ch)).cast("int").alias("y0"))

    fits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), shape), lambda p: p["cw"].between(1, w) & p["ch"].between(1, h))
    return frames.withColumn("props", F.transform(fits, place))


def geometry_params(frames: DataFrame, seed, w: int, h: int, max_angle: float = 10.0, flip: float = 0.5, attempts: int = 10) -> DataFrame:
    """Per frame: angle in degrees, whether to flip, and `attempts` crop proposals as (cw, ch, x0, y0), zeros where one does not fit."""
    key = C("frame_id")
    out = crop_proposals(frames, seed, w, h, attempts)
    flat = F.flatten(F.transform("props", lambda p: F.array(*[p[n] for n in ("cw", "ch", "x0", "y0")])))
    short = F.array_repeat(F.lit(0), F.lit(4 * attempts) - F.size("props") * 4)
    return out.withColumns({"crops": F.concat(flat, short), "angle": uniform_between(-max_angle, max_angle, f"{seed}-angle", key),
                            "flip": uniform(f"{seed}-flip", key) < flip}).drop("props")


def convolution_params(frames: DataFrame, seed) -> DataFrame:
    """Per frame: the stream of its kernel, whether it is 3x3, and the blend."""
    key = C("frame_id")
    return frames.withColumns({"rk": hash_long(f"{seed}-rc", key), "r3": uniform(f"{seed}-k", key) >= 0.5, "ra": uniform(f"{seed}-alpha", key)})


def mix_params(frames: DataFrame, seed, width: int = 3, severity: int = 3) -> DataFrame:
    """Per frame and chain: depth, ops and levels of three steps, weight; and the blend. Weights are exponential, so normalised they sum to one."""
    key, chains = C("frame_id"), [F.lit(b) for b in range(width)]
    return frames.withColumns({
        "mix_depth": F.array(*[F.floor(uniform(f"{seed}-depth", key, b) * 3).cast("int") + 1 for b in chains]),
        "mix_op": F.array(*[F.floor(uniform(f"{seed}-op{k}", key, b) * 4).cast("int") for b in chains for k in range(3)]),
        "mix_level": F.array(*[uniform_between(0.1, float(severity), f"{seed}-level{k}", key, b) for b in chains for k in range(3)]),
        "mix_weight": F.array(*[-F.log(F.greatest(uniform(f"{seed}-weight", key, b), F.lit(1e-12))) for b in chains]),
        "mix_blend": uniform(f"{seed}-blend", key)})


def policy(frames: DataFrame, photometric: str = "jitter", stages=None, strength: float = 1.0, seed=0, geometry: tuple[int, int] | None = None,
           finish=K.planes, schema: str = K.PLANES) -> DataFrame:
    """One named photometric block over frame rows, after one geometric block where `geometry` names their (w, h).

    Unknown modes and stages raise; strength 0 is the photometric identity. `finish` gets values in [0, 1] and returns the
    columns of `schema`. With geometry, frames keep their arrays' size and `cw`, `ch`, `mask` and `box` go with them.
    """
    if photometric not in PHOTOMETRIC_MODES:
        raise ValueError(f"no such photometric mode: {photometric!r} (offered: {', '.join(PHOTOMETRIC_MODES)})")
    if stages is not None and set(stages) - set(CAMERA_STAGES):
        raise ValueError(f"not offered as camera stages: {', '.join(sorted(set(stages) - set(CAMERA_STAGES)))}")
    first = []
    if geometry:
        frames = geometry_params(frames, f"{seed}-geo", *geometry)
        first = [K.geometry, K.to_levels]
    if photometric == "none" or strength <= 0:
        return K.applied(frames, *first, K.to_unit, finish=finish, schema=schema)
    if photometric == "jitter":
        return K.applied(jitter_params(frames, seed, strength), *first, K.color_jitter, finish=finish, schema=schema)
    if photometric == "cpr":
        use = CAMERA_STAGES if stages is None else tuple(stages)
        return K.applied(camera_params(frames, seed, strength, use), *first, K.camera_chain(use), finish=finish, schema=schema)
    if photometric == "randconv":
        return K.applied(convolution_params(frames, seed), *first, K.random_convolution(strength), finish=finish, schema=schema)
    return K.applied(mix_params(frames, seed), *first, K.chain_mix(strength), finish=finish, schema=schema)
