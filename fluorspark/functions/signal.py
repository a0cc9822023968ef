"""Expressions over a cluster's flat signal array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluorspark.model import CHANNELS, INT_MAX, INT_MIN


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clip(value: Column) -> Column:
    """Rounded half away from zero and saturated to 16 bits."""
    return F.greatest(F.lit(INT_MIN), F.least(F.lit(INT_MAX), F.round(value))).cast("smallint")


def decode(vector: Column, scale: float = 1000.0) -> Column:
    """A float vector as a signal."""
    return F.transform(vector, lambda x: clip(x.cast("double") * scale))


def cycles(signal: Column) -> Column:
    return F.floor(F.size(signal) / CHANNELS).cast("int")


def cycle(signal: Column, at: Column | int) -> Column:
    """The four channels of a cycle, counted from 0."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.slice(signal, (at * CHANNELS + 1).cast("int"), F.lit(CHANNELS))


def cut(signal: Column, parts: list[tuple[int, int]]) -> Column:
    """Ranges of cycles (first from 0, number) side by side; what lies beyond the signal is left out."""
    return F.concat(*(F.slice(signal, CHANNELS * first + 1, CHANNELS * n) for first, n in parts))


def per_cycle(signal: Column, use) -> Column:
    """An array with ``use`` of each cycle's channels."""
    return let(signal, lambda s: F.transform(F.sequence(F.lit(0), cycles(s) - 1), lambda c: let(cycle(s, c), use)))


def argmax(channels: Column) -> Column:
    """The strongest channel; of equal ones the first."""
    return (F.array_position(channels, F.array_max(channels)) - 1).cast("tinyint")


def initial_calls(signal: Column) -> Column:
    return let(signal, lambda s: F.when(F.size(s) >= CHANNELS, per_cycle(s, argmax)).otherwise(F.array().cast("array<tinyint>")))


def dark_cycles(signal: Column) -> Column:
    """How many cycles have no data: all channels exactly zero."""
    return F.when(F.size(signal) < CHANNELS, 0).otherwise(F.size(F.filter(per_cycle(signal, lambda ch: F.forall(ch, lambda v: v == 0)), lambda dark: dark)))


def kept(values: Column, valid: Column, each: int = 1) -> Column:
    """The values of valid cycles, ``each`` a cycle; all where ``valid`` is null."""
    return F.when(valid.isNull(), values).otherwise(F.filter(values, lambda v, k: F.get(valid, F.floor(k / each).cast("int"))))


def spread(values: Column, valid: Column, fill: Column) -> Column:
    """The values of valid cycles at their places among all cycles, and ``fill`` at the others; ``kept`` turned round."""
    place = F.transform(valid, lambda _, c: F.size(F.filter(F.slice(valid, F.lit(1), c), lambda ok: ok)))
    whole = let(F.struct(values.alias("v"), place.alias("p")), lambda s: F.transform(valid, lambda ok, c: F.when(ok, F.get(s["v"], F.get(s["p"], c))).otherwise(fill)))
    return F.when(valid.isNull(), values).otherwise(whole)


def synthetic_xy(idx: Column) -> tuple[Column, Column]:
    """Coordinates for clusters that have none: (1,1), (2,1), (2,2), (3,1) and so on."""
    x = F.floor((1 + F.sqrt(1 + 8 * idx.cast("double"))) / 2).cast("bigint")
    return x, 1 + idx - F.floor(x * (x - 1) / 2).cast("bigint")


#: The extent of the spatial grid.
GRID_X, GRID_Y, GRID_CELLS = 1794, 2048, 4


def grid_cell(x: Column, y: Column) -> Column:
    return (F.floor(x * GRID_CELLS / GRID_X) * GRID_CELLS + F.floor(y * GRID_CELLS / GRID_Y)).cast("int")


def in_box(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    return x.between(x0, x1) & y.between(y0, y1)


def unmix(signal: Column, inverse: list[list[float]]) -> Column:
    """Processed intensities of every cycle under one 4 x 4 inverse (base x channel), flat as the signal."""
    row = lambda ch, weights: sum((ch[k].cast("double") * F.lit(float(w)) for k, w in enumerate(weights)), F.lit(0.0))
    return F.flatten(per_cycle(signal, lambda ch: F.array(*(row(ch, w) for w in inverse))))


def expected(calls: Column, brightness: Column, mix: list[list[float]]) -> Column:
    """The signal that bases of a brightness would give, without noise (mix: channel x base)."""
    column = F.array(*(F.array(*(F.lit(float(mix[ch][b])) for ch in range(CHANNELS))) for b in range(CHANNELS)))
    return F.flatten(F.transform(calls, lambda b: F.when(b < CHANNELS, F.transform(F.get(column, b.cast("int")), lambda v: v * brightness)).otherwise(F.array_repeat(F.lit(0.0), CHANNELS))))


def called(processed: Column, calls: Column) -> Column:
    """The processed intensity of each called base; null for an ambiguous one."""
    return let(processed, lambda p: F.transform(calls, lambda b, c: F.when(b < CHANNELS, F.get(p, (c * CHANNELS + b).cast("int")))))


def brightness_ols(processed: Column, calls: Column) -> Column:
    """Mean of the called channels, not below 0; 0 if all bases are ambiguous."""
    total = lambda seen: F.aggregate(seen, F.lit(0.0), lambda a, x: a + x)
    return let(F.array_compact(called(processed, calls)), lambda seen: F.when(F.size(seen) > 0, F.greatest(F.lit(0.0), total(seen) / F.size(seen))).otherwise(0.0))


def squared_error(processed: Column, calls: Column, brightness: Column) -> Column:
    """Sum of squares of processed intensities less the brightness at the called bases."""
    known = F.struct(calls.alias("calls"), brightness.alias("brightness"))
    rest = let(known, lambda s: F.transform(processed, lambda p, k: p - F.when(F.get(s["calls"], F.floor(k / CHANNELS).cast("int")).cast("int") == k % CHANNELS, s["brightness"]).otherwise(0.0)))
    return F.aggregate(rest, F.lit(0.0), lambda a, x: a + x * x)
