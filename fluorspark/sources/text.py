"""Text sources: intensity lines, matrices, calibration tables, spike-in truth and file names."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluorspark.functions.calibration import Table
from fluorspark.functions.signal import clip
from fluorspark.model import CHANNELS


def read_intensities(spark: SparkSession, path: str | list[str], cycles: int = 0) -> DataFrame:
    """Lines of lane, tile, x, y and a field of four reals for each cycle; plain, gzip or bzip2.

    ``cycles`` keeps the first ones only; lines with fewer are left out. ``cluster_idx`` counts a tile's lines
    in their order: tiles are files in this format, and the order is that of the text source. Files that are missing or
    cannot be unpacked are skipped.
    """
    parts = F.split("value", "\t")
    lines = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_line"), parts.alias("f")).where(F.size("f") >= 4)
    wanted = F.size("f") - 4 if not cycles else F.lit(cycles)
    numbers = F.flatten(F.transform(F.slice("f", F.lit(5), wanted), lambda c: F.split(F.trim(c), " +")))
    signal = F.transform(numbers, lambda v: clip(v.cast("double")))
    read = rows.where(F.size("f") - 4 >= wanted).select("file", "_line", F.col("f")[0].cast("int").alias("lane"), F.col("f")[1].cast("int").alias("tile"), F.col("f")[2].cast("bigint").alias("x"), F.col("f")[3].cast("bigint").alias("y"), signal.alias("signal"))
    place = F.row_number().over(Window.partitionBy("file", "lane", "tile").orderBy("_line")) - 1
    return read.select("file", "lane", "tile", place.cast("bigint").alias("cluster_idx"), "x", "y", F.floor(F.size("signal") / CHANNELS).cast("int").alias("ncycle"), "signal")


def read_positions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """lane, tile, cluster_idx (by line), x and y of position files ``s_1_0002_pos.txt``: two reals a line, ten times each, rounded, plus 1000."""
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.monotonically_increasing_id().alias("_line"), F.split(F.trim("value"), "\\s+").alias("f")).where(F.size("f") >= 2)
    lane, tile = lane_and_tile(F.col("name"))
    at = lambda k: (F.round(F.col("f")[k].cast("float").cast("double") * 10) + 1000).cast("bigint")
    place = F.row_number().over(Window.partitionBy("file").orderBy("_line")) - 1
    return rows.select(lane.alias("lane"), tile.alias("tile"), place.cast("bigint").alias("cluster_idx"), at(0).alias("x"), at(1).alias("y"))


def intensity_line(df: DataFrame) -> Column:
    """A cluster as a text line, one decimal for each value."""
    cycles = F.transform(F.sequence(F.lit(0), F.floor(F.size("signal") / CHANNELS).cast("int") - 1), lambda c: F.array_join(F.transform(F.slice("signal", (c * CHANNELS + 1).cast("int"), F.lit(CHANNELS)), lambda v: F.format_string("%.1f", v.cast("double"))), " "))
    return F.concat_ws("\t", "lane", "tile", "x", "y", F.array_join(cycles, "\t"))


def _lines(spark: SparkSession, path: str) -> list[str]:
    """The lines of a parameter file, which is a few kilobytes, in order."""
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0]["value"].splitlines() if rows else []


def parse_matrix(lines: list[str]) -> np.ndarray:
    """``rows columns``, then a column on each line; lines that begin with # are comments, further values ignored."""
    kept = [x.split() for x in lines if x.strip() and not x.lstrip().startswith("#")]
    n, m = map(int, kept[0][:2])
    if len(kept) <= m:
        raise ValueError(f"{len(kept) - 1} columns of {m}")
    columns = [[float(v) for v in line[:n]] for line in kept[1 : m + 1]]
    if any(len(c) < n for c in columns):
        raise ValueError(f"a column has fewer than {n} values")
    return np.array(columns).T


def read_matrix(spark: SparkSession, path: str) -> np.ndarray:
    return parse_matrix(_lines(spark, path))


def matrix_text(matrix: np.ndarray) -> str:
    return "\n".join([f"{matrix.shape[0]} {matrix.shape[1]}", *(" ".join(f"{v:.6f}" for v in column) for column in matrix.T)]) + "\n"


def parse_calibration(lines: list[str]) -> Table:
    """A comment up to an empty line, then the intercept, slope, prior, next and triplet matrices."""
    rest = lines[next(k for k, x in enumerate(lines) if not x.strip()) + 1 :]
    found, at = [], 0
    rest = [x for x in rest if x.strip() and not x.lstrip().startswith("#")]
    for _ in range(5):
        m = int(rest[at].split()[1])
        found.append(parse_matrix(rest[at : at + m + 1]))
        at += m + 1
    flat = [tuple(float(v) for v in x.T.ravel()) for x in found]
    return Table(slope=flat[1][0], intercept=flat[0][0], prior=flat[2], next=flat[3], triplet=flat[4])


def calibration_text(table: Table, comment: str = "calibration") -> str:
    parts = [np.array([[table.intercept]]), np.array([[table.slope]]), np.array(table.prior).reshape(4, 4).T, np.array(table.next).reshape(4, 4).T, np.array(table.triplet).reshape(16, 4).T]
    return f"# {comment}\n\n" + "".join(map(matrix_text, parts))


def read_spikes(spark: SparkSession, path: str | list[str], cycles: int) -> DataFrame:
    """``cluster_idx`` (from 0), ``truth`` cut to the cycles, ``line`` and ``file`` (its name). One bad line makes the whole file unusable."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"), F.split("value", "\t").alias("f")).where(F.col("f")[0] != "")
    good = rows.select("file", "line", F.expr("try_cast(f[0] AS BIGINT)").alias("number"), F.upper(F.get("f", F.lit(1))).alias("truth"))
    bad = good.where(F.col("number").isNull() | (F.col("number") < 1) | F.col("truth").isNull() | (F.length("truth") < cycles) | F.col("truth").rlike("[^ACGTN]"))
    if not bad.isEmpty():
        raise ValueError(f"bad spike-in lines in {path}: {[r['line'] for r in bad.limit(3).collect()]}")
    return good.select((F.col("number") - 1).alias("cluster_idx"), F.substring("truth", 1, cycles).alias("truth"), "line", "file")


def spike_place(name: str, blocks: int = 1) -> tuple[int, int, int] | None:
    """Lane, tile and block (from 0) of a truth file's name; None if it names no lane and tile.

    Truth stands beside ``s_1_2_int.txt`` as ``s_1_2_spike.txt`` and beside ``s_1_2.cif`` as ``s_1_2.spike``; with several
    blocks their number from 1 follows the tag in the first, and is the last digit before the dot in the second.
    """
    import re

    tagged = re.search(r"(\d+)_(\d+)_spike(\d*)(?:\.|$)", name)
    if tagged:
        lane, tile, block = tagged.groups()
    else:
        plain = re.search(r"(\d+)_(\d+?)(\d?)\.spike" if blocks > 1 else r"(\d+)_(\d+)()", name)
        if not plain:
            return None
        lane, tile, block = plain.groups()
    if bool(block) != (blocks > 1) or (block and not 1 <= int(block) <= blocks):
        raise ValueError(f"no block of {blocks} in {name}")
    return int(lane), int(tile), int(block or 1) - 1


def lane_and_tile(name: Column) -> tuple[Column, Column]:
    """The first two numbers of a file name that an underscore joins; 0 if there are none."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(name, "([0-9]+)_([0-9]+)", k), F.lit("")).cast("int"), F.lit(0))
    return part(1), part(2)


def parse_range(text: str) -> tuple[tuple[int, int], tuple[int, int]]:
    """``L2T8`` or ``L1-2T5-9`` as inclusive ranges of lanes and tiles."""
    import re

    m = re.fullmatch(r"[Ll](\d+)(?:-(\d+))?[Tt](\d+)(?:-(\d+))?", text)
    if not m:
        raise ValueError(f"no lane and tile range: {text!r}")
    a, b, c, d = m.groups()
    return (int(a), int(b or a)), (int(c), int(d or c))


def select_files(names: list[str], pattern: str, kind: str) -> list[str]:
    """File names of a folder that a pattern means, sorted: exact, or a prefix if it ends in +; letter case does not count."""
    marker = {"txt": "_int.txt", "cif": ".cif"}[kind]
    p = pattern.lower()
    ok = lambda n: n.lower().startswith(p[:-1]) if p.endswith("+") else n.lower() == p
    return sorted(n for n in names if marker in n.lower() and ok(n))
