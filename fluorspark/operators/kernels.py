"""Row kernels on blocks of clusters: un-mixing, brightness, calling and qualities.

Arrays have a row for each cluster; processed intensities are n x 4C. Loops run over cycles, not rows.
"""

from __future__ import annotations

import numpy as np

from fluorspark.model import CHANNELS, MAX_PHRED, MIN_PHRED
from fluorspark.operators.sufficient import one_hot


def processed(signal: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.linalg.solve(a, (signal - n).T).T


def expected(calls: np.ndarray, brightness: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    return brightness[:, None] * (one_hot(calls) @ a.T) + n


def separable_processed(signal: np.ndarray, mix: np.ndarray, phase: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Un-mixing under the older model, in which a 4 x 4 mix acts on channels and a C x C phasing on cycles."""
    x = (signal - n).reshape(len(signal), -1, CHANNELS)
    return np.einsum("bk,nck,cd->ndb", np.linalg.inv(mix), x, np.linalg.inv(phase), optimize=True).reshape(len(signal), -1)


def separable_expected(calls: np.ndarray, brightness: np.ndarray, mix: np.ndarray, phase: np.ndarray, n: np.ndarray) -> np.ndarray:
    s = one_hot(calls).reshape(len(calls), -1, CHANNELS)
    return brightness[:, None] * np.einsum("kb,ncb,cd->ndk", mix, s, phase, optimize=True).reshape(len(calls), -1) + n


def strongest(p: np.ndarray) -> np.ndarray:
    return p.reshape(len(p), -1, CHANNELS).argmax(axis=2).astype(np.int8)


def brightness(signal: np.ndarray, calls: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Least squares on the raw signal, not below 0."""
    model, y = one_hot(calls) @ a.T, signal - n
    return np.maximum(0.0, (y * model).sum(axis=1) / np.maximum((model * model).sum(axis=1), 1e-300))


def error(p: np.ndarray, calls: np.ndarray, lam: np.ndarray) -> np.ndarray:
    return ((p - lam[:, None] * one_hot(calls)) ** 2).sum(axis=1)


def brightness_ols(p: np.ndarray, calls: np.ndarray) -> np.ndarray:
    known = calls < CHANNELS
    total = (p * one_hot(calls)).sum(axis=1)
    return np.maximum(0.0, np.where(known.any(axis=1), total / np.maximum(known.sum(axis=1), 1), 0.0))


def brightness_wls(p: np.ndarray, calls: np.ndarray, lam: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """One reweighted step: a cycle counts by 1 / (1 + its squared error over its variance)."""
    s = one_hot(calls)
    sse = ((p - lam[:, None] * s) ** 2).reshape(len(p), -1, CHANNELS).sum(axis=2)
    w = np.where(calls < CHANNELS, 1 / (1 + sse / variance), 0.0)
    y = (p * s).reshape(len(p), -1, CHANNELS).sum(axis=2)
    return np.maximum(0.0, (w * y).sum(axis=1) / np.maximum(w.sum(axis=1), 1e-300))


def _costs(p: np.ndarray, lam: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs of each base (n x C x 4) and of neighbouring bases (n x C x 4 x 4, the first cycle's unused)."""
    c = p.shape[1] // CHANNELS
    q = p.reshape(len(p), c, CHANNELS)
    blocks = omega.reshape(c, CHANNELS, c, CHANNELS)
    here = blocks[np.arange(c), :, np.arange(c), :]
    before = blocks[np.arange(c) - 1, :, np.arange(c), :]
    base = lam[:, None, None] * np.einsum("cbb->cb", here) - 2 * np.einsum("nci,cib->ncb", q, here)
    earlier = np.roll(q, 1, axis=1)
    pair = lam[:, None, None, None] * before - np.einsum("nci,cib->ncb", earlier, before)[:, :, None, :] - np.einsum("nci,cai->nca", q, before)[:, :, :, None]
    return base, 2 * pair


def _quadratic(p: np.ndarray, omega: np.ndarray) -> np.ndarray:
    return np.einsum("ni,ij,nj->n", p, omega, p, optimize=True)


def best_path(p: np.ndarray, lam: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The base sequence with the least quadratic form, and that form; ties go to the lower base."""
    base, pair = _costs(p, lam, omega)
    n, c = base.shape[:2]
    cost, back = base[:, 0], np.zeros((n, c, CHANNELS), dtype=np.int8)
    for k in range(1, c):
        step = cost[:, :, None] + pair[:, k]
        back[:, k] = step.argmin(axis=1)
        cost = step.min(axis=1) + base[:, k]
    calls = np.zeros((n, c), dtype=np.int8)
    calls[:, -1] = cost.argmin(axis=1)
    for k in range(c - 1, 0, -1):
        calls[:, k - 1] = back[np.arange(n), k, calls[:, k]]
    return calls, _quadratic(p, omega) + lam * cost.min(axis=1)


def path_score(p: np.ndarray, lam: np.ndarray, omega: np.ndarray, calls: np.ndarray) -> np.ndarray:
    """The quadratic form of a given sequence; an ambiguous base stands for no signal."""
    return _quadratic(p - lam[:, None] * one_hot(calls), omega)


def posterior_quality(p: np.ndarray, lam: np.ndarray, omega: np.ndarray, freedom: float, calls: np.ndarray, generalised: float = 38.0) -> np.ndarray:
    """Quality of each call from the best sequences through each base, under a heavy-tailed error."""
    base, pair = _costs(p, lam, omega)
    n, c = calls.shape
    past, future = np.zeros_like(base), np.zeros_like(base)
    for k in range(1, c):
        past[:, k] = ((base[:, k - 1] + past[:, k - 1])[:, :, None] + pair[:, k]).min(axis=1)
    for k in range(c - 2, -1, -1):
        future[:, k] = ((base[:, k + 1] + future[:, k + 1])[:, None, :] + pair[:, k + 1]).min(axis=2)
    stat = _quadratic(p, omega)[:, None, None] + lam[:, None, None] * (past + future + base)
    stat = np.log1p(np.maximum(stat, 0.0))
    own = np.take_along_axis(stat, calls.astype(int)[:, :, None], axis=2)
    right = -np.expm1(-generalised / 10 * np.log(10)) / np.exp(-0.5 * (1 + freedom) * (stat - own)).sum(axis=2)
    with np.errstate(divide="ignore"):
        return -10 * np.log1p(-right) / np.log(10)


def quality_text(quality: np.ndarray) -> list[str]:
    bounded = np.nan_to_num(quality, nan=0.0, posinf=MAX_PHRED, neginf=0.0) + MIN_PHRED + 0.5
    codes = np.clip(np.floor(bounded), MIN_PHRED, MAX_PHRED).astype(np.uint8)
    return [row.tobytes().decode() for row in codes]


def single_cycle_call(p: np.ndarray, lam: np.ndarray, omega: np.ndarray, penalty: np.ndarray, mu: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Call and quality of one cycle on its own (p: n x 4, a 4 x 4 precision, a penalty for each base).

    The best base's likelihood is weighed against the others' and against ``mu``, the chance of an
    intensity that fits no base. Without brightness the call is A with quality 0.
    """
    rest = p[:, None, :] - lam[:, None, None] * np.eye(CHANNELS)
    form = np.einsum("nbi,ij,nbj->nb", rest, omega, rest) + penalty
    call = form.argmin(axis=1)
    least = form.min(axis=1)
    # numerator and denominator over the best likelihood, or over mu where that is the larger
    top = np.maximum(-0.5 * least, np.log(mu))
    best, odd = np.exp(-0.5 * least - top), np.exp(np.log(mu) - top)
    share = (np.exp(-0.5 * penalty[call]) * odd + best) / (CHANNELS * odd + best * np.exp(-0.5 * (form - least[:, None])).sum(axis=1))
    dark = lam == 0
    return np.where(dark, 0, call).astype(np.int8), np.where(dark, 0.0, -10 * np.log1p(-share) / np.log(10))
