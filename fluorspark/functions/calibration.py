"""Quality calibration by table: a line in the quality plus effects of the neighbouring bases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluorspark.functions.signal import let
from fluorspark.model import AMBIGUOUS

# The default calibration. Rows of PRIOR by the base before, of NEXT by the base after,
# of TRIPLET by both (the base after changes slower); columns by the called base A C G T.
SLOPE, INTERCEPT = 0.506914, 11.764940
PRIOR = (
    3.192375, -1.902603, -3.208594, 2.460897,
    0.562182, 0.303319, -0.067780, 0.097604,
    -0.122656, -6.690310, -2.094634, 2.267631,
    -0.042027, 1.054893, 1.929572, 2.260132,
)
NEXT = (
    -0.129802, -0.129802, -0.129802, -0.129802,
    -4.233149, 1.571371, 5.009493, -3.925572,
    -4.498307, 0.578277, 3.425450, -0.933406,
    -2.531318, 0.178935, 3.411972, 2.465463,
)
TRIPLET = (
    0.519254, 0.519254, 0.519254, 0.519254,
    0.519254, 0.519254, 0.519254, 0.519254,
    0.519254, 0.519254, 0.519254, 0.519254,
    0.519254, 0.519254, 0.519254, 0.519254,
    0.519254, 0.519254, 0.519254, 0.519254,
    0.477842, -6.341096, -2.618576, 7.581727,
    1.477224, 3.451053, -3.082730, 3.721204,
    1.726990, -3.548729, -12.490456, 3.884434,
    0.519254, 0.519254, 0.519254, 0.519254,
    3.146514, -4.293363, -5.968356, 4.207439,
    1.983776, 5.372614, -4.067117, -0.010691,
    1.169058, -4.469321, -2.993632, 1.417203,
    0.519254, 0.519254, 0.519254, 0.519254,
    1.740356, -2.765277, -3.042999, 1.797095,
    -0.918003, 5.640177, -0.915497, -0.048110,
    1.441490, -1.990358, -5.344032, 0.133029,
)


@dataclass(frozen=True)
class Table:
    slope: float = SLOPE
    intercept: float = INTERCEPT
    prior: tuple[float, ...] = PRIOR
    next: tuple[float, ...] = NEXT
    triplet: tuple[float, ...] = TRIPLET


def _at(values: tuple[float, ...], place: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), place.cast("int"))


def adjusted(quality: Column, prior: Column, base: Column, next_: Column, table: Table = Table()) -> Column:
    """The calibrated quality of one call; neighbours that are ambiguous or missing (null) count for nothing."""
    known = lambda b: b.isNotNull() & (b != AMBIGUOUS)
    before = F.when(known(prior), _at(table.prior, prior * 4 + base)).otherwise(0.0)
    after = F.when(known(next_), _at(table.next, next_ * 4 + base)).otherwise(0.0)
    both = F.when(known(prior) & known(next_), _at(table.triplet, (next_ * 4 + prior) * 4 + base)).otherwise(0.0)
    return F.when(base == AMBIGUOUS, 0.0).otherwise(F.lit(table.intercept) + F.lit(table.slope) * quality + before + after + both)


def calibrate(qualities: Column, calls: Column, brightness: Column, table: Table = Table()) -> Column:
    """All qualities of a cluster; a cluster without brightness keeps its own."""
    new = let(calls, lambda k: F.transform(qualities, lambda q, c: adjusted(q, F.when(c > 0, F.get(k, c - 1)), F.get(k, c), F.get(k, c + 1), table)))
    return F.when(brightness == 0, qualities).otherwise(new)
