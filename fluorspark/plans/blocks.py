"""Block strings: which cycles form which read. ``R`` begins a read, ``C`` continues it, ``I`` skips."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluorspark.functions import signal as sig


def parse(text: str) -> list[list[tuple[int, int]]]:
    """For each block its ranges (first cycle from 0, number). ``R4I2C3`` is one block of cycles 0-3 and 6-8."""
    if not re.fullmatch(r"(?:[RICric]\d+)+", text):
        raise ValueError(f"no block string: {text!r}")
    blocks: list[list[tuple[int, int]]] = []
    at = 0
    for kind, digits in re.findall(r"(\D)(\d+)", text):
        n = int(digits)
        if n <= 0:
            raise ValueError(f"no cycles in {kind}{digits}")
        if kind in "Rr":
            blocks.append([(at, n)])
        elif kind in "Cc":
            if not blocks:
                raise ValueError("a block is continued before the first read")
            blocks[-1].append((at, n))
        at += n
    return blocks


def split(clusters: DataFrame, text: str) -> DataFrame:
    """A row for each cluster and block, ``signal`` and, if there is one, ``valid`` cut to the block's cycles; ``block`` counts from 0."""
    masked = "valid" in clusters.columns
    parts = []
    for k, ranges in enumerate(parse(text)):
        fields = [F.lit(k).alias("block"), sig.cut(F.col("signal"), ranges).alias("signal")]
        if masked:
            own = F.concat(*(F.slice("valid", first + 1, n) for first, n in ranges))
            fields.append(F.when(F.exists(own, lambda v: ~v), own).alias("valid"))
        parts.append(F.struct(*fields))
    rest = [c for c in clusters.columns if c not in ("signal", "block", "valid")]
    cut = ["block", "signal"] + ["valid"] * masked
    return clusters.select(*rest, F.explode(F.array(*parts)).alias("_b")).select(*rest, *(F.col(f"_b.{c}").alias(c) for c in cut))


def wanted(text: str) -> tuple[list[int], str]:
    """The cycles that a block string reads, from 1, and the block string over these cycles alone."""
    cycles = [first + k + 1 for ranges in parse(text) for first, n in ranges for k in range(n)]
    return cycles, "".join(f"{'R' if k == 0 else 'C'}{n}" for ranges in parse(text) for k, (_, n) in enumerate(ranges))
