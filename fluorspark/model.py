"""The data model: a row for each cluster, its signal a flat array (cycle-major, channels A C G T)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

CHANNELS = 4
BASES = "ACGTN"
AMBIGUOUS = 4
INT_MIN, INT_MAX = -32768, 32767
MIN_QUALITY, MAX_QUALITY = 0, 93
MIN_PHRED, MAX_PHRED = 33, 126

CLUSTERS = "sample string, lane int, tile int, block int, cluster_idx bigint, x bigint, y bigint, ncycle int, signal array<smallint>"

#: The initial crosstalk, a row for each base and in it the channels A C G T.
INITIAL_CROSSTALK = (
    (1.08, 1.13, 0.02, 0.01),
    (0.20, 0.93, 0.02, 0.02),
    (0.01, 0.02, 1.00, 0.53),
    (0.00, 0.01, 0.05, 1.32),
)


def crosstalk() -> np.ndarray:
    """channel x base."""
    return np.array(INITIAL_CROSSTALK).T


@dataclass
class Params:
    """Model parameters of one tile: vec(signal) = brightness * A vec(sequence) + N, precision Omega.

    ``scale`` is what brightness took over when A was normalised, ``freedom`` the degrees of freedom of the error.
    """

    a: np.ndarray
    n: np.ndarray
    omega: np.ndarray | None = None
    scale: float | None = None
    freedom: float | None = None

    @classmethod
    def initial(cls, cycles: int, mix: np.ndarray | None = None) -> Params:
        return cls(np.kron(np.eye(cycles), crosstalk() if mix is None else mix), np.zeros(CHANNELS * cycles))

    def kept(self, valid: np.ndarray | None) -> Params:
        """A and N of the valid cycles alone."""
        if valid is None:
            return self
        at = np.repeat(np.asarray(valid, dtype=bool), CHANNELS)
        return Params(self.a[np.ix_(at, at)], self.n[at])

    def spread(self, valid: np.ndarray | None) -> Params:
        """Parameters of all cycles: those that are not valid have the initial crosstalk, no noise and no precision."""
        if valid is None:
            return self
        at = np.repeat(np.asarray(valid, dtype=bool), CHANNELS)
        out = Params.initial(len(valid))
        out.a[np.ix_(at, at)], out.n[at], out.scale, out.freedom = self.a, self.n, self.scale, self.freedom
        if self.omega is not None:
            out.omega = np.zeros_like(out.a)
            out.omega[np.ix_(at, at)] = self.omega
        return out


@dataclass(frozen=True)
class Options:
    """What a run can set; the command line has a flag for each."""

    iterations: int = 5
    generalised_error: float = 38.0
    thin: int = 1
    zero_thin: int = 3
    ridge: float = 1e5
    delta: float = 1.0
    min_cycles: int = 2
    blocks: str = ""
    sample: str = "Sample"
    calibrate: bool = True
    mu: float = 1e-5
    mask_nodata: bool = False
    solver: str = "cholesky"
    fixed: Params | None = field(default=None, compare=False)
