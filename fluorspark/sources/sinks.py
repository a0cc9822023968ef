"""Sinks: sequences with qualities, and the names of output files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluorspark.functions import nucleotides as nuc
from fluorspark.functions import signal as sig
from fluorspark.model import CHANNELS
from fluorspark.operators import kernels
from fluorspark.operators.parameters import BlockFiles
from fluorspark.operators.statistics import logistic_fit
from fluorspark.operators.sufficient import matrix_of, one_hot, partial_sums, robust_weights
from fluorspark.sources import named
from fluorspark.sources.text import intensity_line


def record_name(sample: str, blocks: int) -> Column:
    """``sample:lane:tile:x:y``, with the block from 1 if there are several."""
    name = F.concat_ws(":", F.lit(sample), "lane", "tile", "x", "y")
    return F.concat_ws("/", name, (F.col("block") + 1).cast("string")) if blocks > 1 else name


def sequence_text(name: Column, bases: Column, quality: Column | None = None) -> Column:
    """A record as text: with qualities if there are any, whatever the compression."""
    if quality is None:
        return F.concat(F.lit(">"), name, F.lit("\n"), bases)
    return F.concat(F.lit("@"), name, F.lit("\n"), bases, F.lit("\n+\n"), quality)


def output_name(name: Column, tag: str, kind: str, block: Column | None = None, sample: str | None = None) -> Column:
    """The output of an input file. Of a binary one the tag takes the place of the suffix, of a text one that of what stands between its last underscore and
    its first dot, and a suffix of compression goes; the block, counted from 1, stands before the tag. A sample's name stands for all inputs if it is given."""
    digit = F.lit("") if block is None else (block + 1).cast("string")
    if sample is not None:
        return F.concat(F.lit(sample), F.lit("" if block is None else "_"), digit, F.lit(f".{tag}"))
    if kind == "cif":
        return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), digit, F.lit(f".{tag}"))
    body, rest = F.regexp_extract(name, "^(.*)_", 1), F.regexp_extract(name, r"^[^.]*(\..*)?$", 1)
    return F.concat(body, digit, F.when(name.contains("_"), "_").otherwise(""), F.lit(tag), F.regexp_replace(rest, r"\.(gz|bz2)$", ""))


@dataclass(frozen=True)
class Outputs:
    """Where a run's files go and what they are called: input ``kind`` (txt or cif), whether there are several blocks, and the sample's name if its outputs are put together."""

    folder: str
    kind: str
    blocks: bool = False
    sample: str | None = None

    def named(self, rows: DataFrame, tag: str) -> DataFrame:
        return rows.withColumn("file", output_name(F.col("name"), tag, self.kind, F.col("block") if self.blocks else None, self.sample))

    def text(self, rows: DataFrame, tag: str, order: list[str], packed: str = "") -> None:
        """Lines ``value`` of rows with ``name``, lane, tile and block as files, one for each tile and block; those of a sample put together follow what its file holds."""
        named.write_text(self.named(rows, tag), self.folder, [*PLACE, *order] if self.sample else [*order], packed, append=self.sample is not None)


def write_sequences(calls: DataFrame, out: Outputs, sample: str = "Sample", form: str = "fastq") -> None:
    """The records of each tile and block in the order of clusters; ``form`` is fasta or fastq, with .gz or .bz2."""
    kind, _, packed = form.partition(".")
    record = F.concat_ws("/", record_name(sample, 1), (F.col("block") + 1).cast("string"))
    text = sequence_text(record, nuc.chars(F.col("calls")), F.col("quality") if kind == "fastq" else None)
    rows = calls.select("name", *PLACE, "cluster_idx", text.alias("value"))
    out.text(rows, form if out.kind == "cif" else "seq", ["cluster_idx"], packed if out.kind == "cif" else "")


PLACE = ("lane", "tile", "block")


def spike_text(counts: DataFrame) -> DataFrame:
    """The counts by quality as lines of quality, differences and observations."""
    return counts.orderBy("q").select(F.concat_ws("\t", "q", "diff", "obs").alias("value"))


def write_spike_counts(counts: DataFrame, out: Outputs) -> None:
    """The counts of each lane, tile and block (and ``name``) as 94 lines in quality order."""
    out.text(counts.select("name", *PLACE, "q", F.concat_ws("\t", "q", "diff", "obs").alias("value")), "qspike", ["q"])


def simulation_text(cycles: int, location: float, scale: float, covariance: list[list[float]], command: str = "", version: int = 5) -> str:
    """What a simulator needs of a fit: the logistic brightness and the residual covariance. Line breaks in the command stay comments."""
    head = [f"# {version}", *(f"# {line}" for line in command.splitlines() if line)]
    return "\n".join([*head, f"{cycles} L {location:.6f} {scale:.6f}", *(" ".join(f"{v:.6f}" for v in row) for row in covariance)]) + "\n"


def simulations(calls: DataFrame, files: BlockFiles, command: str = "") -> DataFrame:
    """``name``, lane, tile, block and the text of a simulation file for each tile (``key``) of one block: the logistic fit of all brightness but zero, and
    the whole weighted covariance of the residuals, in valid cycles, of the clusters that the fit used."""
    kept = sig.kept(F.col("calls"), F.col("valid"))
    used = robust_weights(calls.where("used AND size(signal) > 0").select(F.col("key").alias("tile"), "signal", kept.alias("calls"), "brightness", "lse"), ["tile"])

    def spread(tile: int, c: list[pa.Array]) -> np.ndarray:
        found, signal, w = files[tile], matrix_of(c[0]), c[3].to_numpy()
        if found is None:
            return np.zeros(signal.shape[1] ** 2 + 1)
        r = kernels.processed(signal, found.a, found.n) - c[2].to_numpy()[:, None] * one_hot(matrix_of(c[1], np.int8))
        return np.r_[((r * w[:, None]).T @ r).ravel(), w.sum()]

    location, scale = logistic_fit(F.col("brightness"))
    light = calls.where("brightness != 0").groupBy("key", "name", *PLACE).agg(location.alias("location"), scale.alias("scale"))
    sums = partial_sums(used, ["signal", "calls", "brightness", "weight"], spread).withColumnRenamed("tile", "key")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for k in range(batch.num_rows):
                v = batch.column("v")[k].values.to_numpy()
                m = int(round((len(v) - 1) ** 0.5))
                made.append(simulation_text(m // CHANNELS, batch.column("location")[k].as_py(), batch.column("scale")[k].as_py() or 0.0, (v[:-1] / max(v[-1], 1e-300)).reshape(m, m).tolist(), command).rstrip("\n"))
            yield pa.RecordBatch.from_arrays([batch.column("name"), *(batch.column(c) for c in PLACE), pa.array(made, pa.string())], names=["name", *PLACE, "value"])

    return light.join(sums, "key").select("name", *PLACE, "location", "scale", "v").mapInArrow(write, "name string, lane int, tile int, block int, value string")


def parameters(tiles: DataFrame, files: BlockFiles) -> DataFrame:
    """The fitted parameters of ``tiles`` (key, name, lane, tile, block, valid), read by tasks: a (by rows), n, omega, scale and effdf over all cycles; tiles without any are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [files[t] for t in batch.column("key").to_pylist()]
            own = batch.filter(pa.array([p is not None for p in found], pa.bool_()))
            found = [p.spread(v) for p, v in zip((p for p in found if p is not None), own.column("valid").to_pylist(), strict=True)]
            lists = lambda get: pa.array([get(p).ravel().tolist() for p in found], pa.list_(pa.float64()))
            numbers = lambda get: pa.array([get(p) for p in found], pa.float64())
            values = [lists(lambda p: p.a), lists(lambda p: p.n), lists(lambda p: p.omega), numbers(lambda p: p.scale), numbers(lambda p: p.freedom)]
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("name", *PLACE)), *values], names=["name", *PLACE, "a", "n", "omega", "scale", "effdf"])

    return tiles.select("key", "name", *PLACE, "valid").mapInArrow(read, "name string, lane int, tile int, block int, a array<double>, n array<double>, omega array<double>, scale double, effdf double")


def matrix_lines(values: Column, rows: int | Column) -> Column:
    """A matrix, given by its rows, as the text of a matrix file: its size, then a column on each line."""
    n = F.lit(rows) if isinstance(rows, int) else rows
    m = F.floor(F.size(values) / n).cast("int")
    column = lambda c: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.format_string("%.6f", F.get(values, r * m + c))), " ")
    return F.concat(n.cast("string"), F.lit(" "), m.cast("string"), F.lit("\n"), F.array_join(F.transform(F.sequence(F.lit(0), m - 1), column), "\n"))


def write_matrices(held: DataFrame, out: Outputs) -> None:
    """A and N of every tile and block as matrix files; N has a column for each cycle."""
    cycles = F.floor(F.size("n") / CHANNELS).cast("int")
    by_channel = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(CHANNELS - 1)), lambda ch: F.transform(F.sequence(F.lit(0), cycles - 1), lambda c: F.get("n", c * CHANNELS + ch))))
    for tag, text in (("A", matrix_lines(F.col("a"), F.size("n"))), ("N", matrix_lines(by_channel, CHANNELS))):
        out.text(held.select("name", *PLACE, text.alias("value")), tag, ["block"])


def write_processed(calls: DataFrame, files: BlockFiles, out: Outputs) -> None:
    """The un-mixed intensities of one block in the form of the input, a file for each tile; cycles without data are zeros."""
    rows = processed(calls.where("size(signal) > 0").select("key", "name", *PLACE, "cluster_idx", "x", "y", "signal", "valid"), files).drop("signal")
    each = F.flatten(F.transform("valid", lambda v: F.array_repeat(v, CHANNELS)))
    rows = rows.withColumn("signal", sig.spread(F.col("processed"), each, F.lit(0.0)))
    if out.kind == "txt":
        out.text(rows.withColumn("value", intensity_line(rows)), "pif", ["cluster_idx"])
    else:
        named.write_intensities(out.named(rows, "pif"), out.folder)


def processed(calls: DataFrame, files: BlockFiles) -> DataFrame:
    """Adds ``processed``, the un-mixed intensities under the fitted parameters of each tile (``key``); tiles without any are left out."""
    schema = ", ".join(f"`{c}` {t}" for c, t in calls.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for key in np.unique(keys):
                found, own = files[int(key)], batch.take(pa.array(np.flatnonzero(keys == key)))
                if found is not None:
                    p = kernels.processed(matrix_of(own.column("signal")), found.a, found.n)
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(list(p), pa.list_(pa.float64()))], names=[*own.schema.names, "processed"])

    return calls.mapInArrow(run, f"{schema}, processed array<double>")


def final_values(state: DataFrame, folder: str) -> None:
    """The fit's cluster state as Parquet, a folder for each lane, tile and block, in place of what was there."""
    state.drop("signal").write.mode("overwrite").partitionBy(*PLACE).parquet(folder)
