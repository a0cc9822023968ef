"""The command line: ``python -m fluorspark.plans.cli [options] pattern...``; options keep their one-letter names."""

from __future__ import annotations

import argparse
import json
import logging
import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluorspark.functions import calibration
from fluorspark.model import CHANNELS, MIN_PHRED, Options, Params
from fluorspark.operators import joins, parameters
from fluorspark.operators.solve import SOLVERS
from fluorspark.plans import blocks, entry
from fluorspark.sources import cif, named, sinks, text

log = logging.getLogger("fluorspark")
#: A lane and a tile as one number, the key of a fit.
TILES_A_LANE = 100_000


VERSION = "fluorspark 0.2"
LICENCE = "See the file LICENSE of the distribution, if there is one; there is no warranty."
WORKING = ("none", "matrices", "values", "processed")


def uint(text: str) -> int:
    """A whole number as the C library reads it with base 0: 0x for hexadecimal, a leading 0 for octal; what is negative counts as 0."""
    m = re.fullmatch(r"\s*([+-]?)(?:0[xX]([0-9a-fA-F]+)|0([0-7]*)|([1-9][0-9]*))", text)
    if not m:
        raise argparse.ArgumentTypeError(f"no number: {text!r}")
    sign, sixteen, eight, ten = m.groups()
    value = int(sixteen, 16) if sixteen else int(eight or "0", 8) if ten is None else int(ten)
    return 0 if sign == "-" else value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fluorspark", description="Call bases and qualities from intensities.")
    add = p.add_argument
    add("pattern", nargs="+", help="file names, prefixes ending in +, or a lane and tile range with -r")
    add("-A", dest="parameter_a", help="fixed mixing matrix; needs -N")
    add("-N", dest="noise", help="fixed noise matrix; needs -A")
    add("-M", dest="crosstalk", help="initial crosstalk matrix")
    add("-b", dest="blocks", default="", help="block string such as R76I1R76")
    add("-c", dest="concatenate", action="store_true", help="one output for the sample, behind what is there")
    add("-d", dest="dataformat", type=str.lower, choices=("txt", "cif"), default="cif")
    add("-e", dest="logfile")
    add("-l", dest="loglevel", default="warning", type=str.lower, choices=("none", "fatal", "error", "information", "warning", "debug"))
    add("-f", dest="format", default="fastq", type=str.lower, choices=[a + b for a in ("fasta", "fastq") for b in ("", ".gz", ".bz2")])
    add("-g", dest="generr", type=float, default=38.0)
    add("-i", dest="input", default=".")
    add("-o", dest="output", default=".")
    add("-K", dest="spikes", help="folder of spike-in truth, a file for each tile and block; or the file of a single tile")
    add("-k", dest="spike_calibrate", action="store_true", help="with -K: replace qualities by what the spike-ins show, instead of writing the counts")
    add("-m", dest="mu", type=float, default=1e-5, help="chance of an intensity that fits no base, of single-cycle calls only")
    add("-n", dest="iterations", type=uint, default=5)
    add("-p", dest="partitions", type=uint, help="shuffle partitions")
    add("-q", dest="no_calibration", action="store_true")
    add("-Q", dest="calibration", help="calibration table")
    add("-r", dest="run_folder", action="store_true")
    add("-s", dest="simulation", help="write simulation files with this header")
    add("-S", dest="sample", default="Sample")
    add("-t", dest="thin", type=uint, default=1)
    add("-w", dest="working", nargs="?", const="processed", default="none", type=str.lower, choices=WORKING, help="working outputs; each level has those before it")
    add("-z", dest="zero_thin", type=uint, default=3)
    p.add_argument("--mask-nodata", dest="mask_nodata", action="store_true", help="call N where a cycle is zero in all clusters of a tile")
    p.add_argument("--solver", dest="solver", type=str.lower, choices=SOLVERS, default="cholesky", help="how the mixing matrix is solved for")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--licence", "--license", action="version", version=LICENCE, help="show the licence and stop")
    return p


def options_of(spark: SparkSession, args: argparse.Namespace) -> Options:
    """The run's options; fixed A and N come together or not at all."""
    if bool(args.parameter_a) != bool(args.noise):
        raise ValueError("-A and -N are given together")
    if args.iterations < 1 or args.thin < 1:
        raise ValueError("iterations and thinning are at least 1")
    if args.blocks:
        blocks.parse(args.blocks)
    fixed = None
    if args.parameter_a:
        fixed = Params(text.read_matrix(spark, args.parameter_a), text.read_matrix(spark, args.noise).T.ravel())
    return Options(iterations=args.iterations, generalised_error=args.generr, thin=args.thin, zero_thin=args.zero_thin, blocks=args.blocks, sample=args.sample, calibrate=not args.no_calibration, fixed=fixed, mu=args.mu, mask_nodata=args.mask_nodata, solver=args.solver)


def _listed(spark: SparkSession, folder: str) -> list[str]:
    """The names of a folder's files, by the store that Spark reads from."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in store.listStatus(path) if x.isFile())


def _paths(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    names = [n for p in args.pattern for n in text.select_files(_listed(spark, args.input), p, args.dataformat)]
    if not names:
        raise ValueError(f"no files for {args.pattern} in {args.input}")
    return [f"{args.input}/{n}" for n in names]


def read(spark: SparkSession, args: argparse.Namespace, cycles: list[int] | None = None) -> DataFrame:
    """All clusters that the patterns mean: lane, tile, cluster_idx, x, y, signal, valid and ``name``, their file's; of binary files the ``cycles`` alone, if they are given."""
    if args.run_folder:
        rows = read_folder(spark, args.input, args.pattern, cycles)
        return rows.withColumn("name", F.concat(F.lit("s_"), "lane", F.lit("_"), "tile", F.lit(".cif")))
    paths = _paths(spark, args)
    name = F.element_at(F.split("file", "/"), -1).alias("name")
    valid = F.lit(None).cast("array<boolean>").alias("valid")
    if args.dataformat == "txt":
        rows = text.read_intensities(spark, paths)
    else:
        rows = cif.load(spark, cif.CifSource, cycles or (), path=",".join(paths))
    return rows.select("lane", "tile", "cluster_idx", "x", "y", "signal", valid, name)


def width(spark: SparkSession, args: argparse.Namespace, clusters: DataFrame) -> int:
    """The most cycles of any tile: by the names of a run folder, the headers of binary files, the lines of text."""
    if args.run_folder:
        return folder_width(spark, args.input, args.pattern)
    if args.dataformat == "txt":
        return (clusters.agg(F.max(F.size("signal"))).first()[0] or 0) // CHANNELS

    def heads(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([cif.cycles_of(p) for p in batch.column(0).to_pylist()], pa.int32())], names=["cycles"])

    paths = spark.createDataFrame([(p,) for p in _paths(spark, args)], "path string")
    return paths.mapInArrow(heads, "cycles int").agg(F.max("cycles")).first()[0] or 0


def _globbed(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """Paths that a pattern means, and their bytes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted((x.getPath().toString().replace("file:/", "file:///"), x.getLen()) for x in found)


def folder_width(spark: SparkSession, root: str, ranges: list[str]) -> int:
    """The greatest cycle that a folder of the lanes is named after."""
    found = [0]
    for lanes, _ in map(text.parse_range, ranges):
        for lane in range(lanes[0], lanes[1] + 1):
            names = _globbed(spark, f"{root}/Data/Intensities/L{lane:03d}/C*.1")
            found += [int(m[1]) for m in (re.search(r"/C(\d+)\.1/?$", n) for n, _ in names) if m]
    return max(found)


def read_folder(spark: SparkSession, root: str, ranges: list[str], cycles: list[int] | None = None) -> DataFrame:
    """Tiles of a run folder, whose cycles stand in files of their own; tiles that are missing are skipped.

    Coordinates come from the tile's position file; a tile without one has synthetic coordinates. The driver lists names and sizes and opens no
    file. A tile without a cycle that others have, or that is among ``cycles``, has it marked in ``valid``.
    """
    tiles, positions, sizes = {}, [], {}
    for lanes, numbers in map(text.parse_range, ranges):
        for lane in range(lanes[0], lanes[1] + 1):
            held: dict[int, list[str]] = {}
            for name, size in _globbed(spark, f"{root}/Data/Intensities/L{lane:03d}/C*.1/s_{lane}_*.cif*"):
                m = re.fullmatch(rf"s_{lane}_(\d+)\.cif(?:\.gz|\.bz2)?", name.rsplit("/", 1)[-1])
                if m:
                    held.setdefault(int(m[1]), []).append(name)
                    sizes[lane, int(m[1])] = sizes.get((lane, int(m[1])), 0) + size
            placed = {int(re.search(r"_(\d+)_pos\.txt$", n)[1]): n for n, _ in _globbed(spark, f"{root}/Data/Intensities/s_{lane}_[0-9][0-9][0-9][0-9]_pos.txt")}
            for tile in range(numbers[0], numbers[1] + 1):
                if tile not in held:
                    log.warning("no cycles for lane %d tile %d", lane, tile)
                    continue
                tiles[lane, tile] = held[tile]
                if tile in placed:
                    positions.append((lane, tile, placed[tile]))
                else:
                    log.warning("no coordinates for lane %d tile %d", lane, tile)
    if not tiles:
        raise ValueError(f"no tiles for {ranges}")
    listed = json.dumps([[*at, paths, sizes[at]] for at, paths in tiles.items()])
    rows = cif.load(spark, cif.FolderSource, cycles or (), tiles=listed, width=str(folder_width(spark, root, ranges)))
    if not positions:
        return rows
    known = F.lit(False)
    for lane in sorted({p[0] for p in positions}):
        known = known | ((F.col("lane") == lane) & F.col("tile").isin([p[1] for p in positions if p[0] == lane]))
    places = text.read_positions(spark, [p[2] for p in dict.fromkeys(positions)])
    with_places = joins.with_coordinates(rows.where(known), places, ["lane", "tile", "cluster_idx"])
    return with_places.select(*rows.columns).unionByName(rows.where(~known))


def read_truth(spark: SparkSession, location: str, places: DataFrame, cycles: list[int]) -> DataFrame:
    """lane, tile, block, cluster_idx, truth and line of the truth files of a folder, or of one file; ``cycles`` are the blocks'.

    A file whose name has no lane and tile is that of the run's only tile and block.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    alone = store.getFileStatus(path).isFile()
    names = [path.getName()] if alone else [n for n in _listed(spark, location) if "spike" in n.lower()]
    root = str(path.getParent()) if alone else location
    found = {n: text.spike_place(n, len(cycles)) for n in names}
    if not found:
        raise ValueError(f"no spike-in truth in {location}")
    if None in found.values():
        tiles = places.select("lane", "tile").distinct().limit(2).collect()
        if len(found) > 1 or len(tiles) > 1 or len(cycles) > 1:
            raise ValueError(f"no lane and tile in the name of {[n for n, at in found.items() if at is None][0]}")
        found = dict.fromkeys(found, (tiles[0]["lane"], tiles[0]["tile"], 0))
    if len(set(found.values())) < len(found):
        raise ValueError(f"several truth files of one tile and block in {location}")
    keys = spark.createDataFrame([(n, *at) for n, at in found.items()], "name string, lane int, tile int, block int")
    out = None
    for block, n in enumerate(cycles):
        own = [f"{root}/{name}" for name, at in found.items() if at[2] == block]
        if own:
            rows = text.read_spikes(spark, own, n)
            out = rows if out is None else out.unionByName(rows)
    return out.join(F.broadcast(keys), F.col("file") == F.col("name")).select("lane", "tile", "block", "cluster_idx", "truth", "line")


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Reads, fits, calls and writes; returns the calls."""
    if args.run_folder:
        args.dataformat = "cif"
    options = options_of(spark, args)
    pushed = None
    if options.blocks and args.dataformat == "cif":
        pushed, own_blocks = blocks.wanted(options.blocks)
        options = replace(options, blocks=own_blocks)
    clusters = read(spark, args, pushed)
    wide = len(pushed) if pushed else width(spark, args, clusters)
    if wide < options.min_cycles:
        raise ValueError(f"{wide} cycles; at least {options.min_cycles} are needed")
    keyed = clusters.withColumn("key", F.col("lane") * TILES_A_LANE + F.col("tile"))
    table = calibration.Table() if not args.calibration else text.parse_calibration(text._lines(spark, args.calibration))
    places = keyed.select("cluster_idx", "key", "lane", F.col("tile").alias("of"), "x", "y", "name")
    truth = None
    if args.spikes:
        cycles = [sum(n for _, n in own) for own in blocks.parse(options.blocks)] if options.blocks else [wide]
        truth = parameters.shared_cut(read_truth(spark, args.spikes, places.select("lane", F.col("of").alias("tile")), cycles))
        odd = joins.unmatched(truth, keyed.select("lane", "tile", "cluster_idx"), ["lane", "tile", "cluster_idx"])
        for row in odd.limit(10).collect():
            log.warning("spike-in cluster %d is not in lane %d tile %d", row["cluster_idx"] + 1, row["lane"], row["tile"])
    known = None if truth is None else truth.select((F.col("lane") * TILES_A_LANE + F.col("tile")).alias("tile"), "block", "cluster_idx", "truth", "line")
    calls, files = entry.fitted(keyed.select("cluster_idx", F.col("key").alias("tile"), "signal", "valid"), options, table, text.read_matrix(spark, args.crosstalk) if args.crosstalk else None, known)
    # read and joined once: every output takes its rows from here
    out = parameters.shared_cut(calls.withColumnRenamed("tile", "key").join(places, ["key", "cluster_idx"]).withColumnRenamed("of", "tile"))
    to = sinks.Outputs(args.output, args.dataformat, len(files) > 1, args.sample if args.concatenate else None)
    if truth is not None:
        out = _by_spikes(out, truth, args, to)
    elif options.calibrate:
        run_name = re.sub(r"\.[^.]*$", "", args.logfile.rsplit("/", 1)[-1]) if args.logfile else args.sample
        held = spark.createDataFrame([(f"{run_name}.tab", 0, text.calibration_text(table).rstrip("\n"))], "file string, at int, value string")
        named.write_text(held, args.output, ["at"])
    _working(out, files, args, to)
    sinks.write_sequences(out, to, options.sample, args.format)
    return out


def _by_spikes(calls: DataFrame, truth: DataFrame, args: argparse.Namespace, to: sinks.Outputs) -> DataFrame:
    """Counts the spike-ins' calls by quality, for each lane, tile and block; writes the counts, or replaces all qualities by what they show."""
    each = joins.with_truth(calls, truth, [*sinks.PLACE, "cluster_idx"]).where("spiked").select(*sinks.PLACE, F.explode(F.sequence(F.lit(1), F.length("truth"))).alias("c"), "bases", "truth", "quality")
    letter = lambda name: F.substring(name, F.col("c"), F.lit(1))
    counts = joins.quality_counts(each.select(*sinks.PLACE, letter("bases").alias("call"), letter("truth").alias("truth"), (F.ascii(letter("quality")) - MIN_PHRED).alias("q")), sinks.PLACE)
    if args.spike_calibrate:
        return joins.recalibrated_text(calls, counts, list(sinks.PLACE))
    names = calls.groupBy(*sinks.PLACE).agg(F.first("name").alias("name"))
    sinks.write_spike_counts(counts.join(names, list(sinks.PLACE)), to)
    return calls


def _working(calls: DataFrame, files: list[parameters.BlockFiles], args: argparse.Namespace, to: sinks.Outputs) -> None:
    """The working outputs of the chosen level and of those before it, and the simulation files."""
    level = WORKING.index(args.working)
    held, runs = None, None
    for block, own in enumerate(files):
        rows = calls.where(F.col("block") == block)
        if level >= 1:
            tiles = rows.groupBy("key", *sinks.PLACE).agg(F.first("name").alias("name"), F.first("valid").alias("valid"))
            found = sinks.parameters(tiles, own)
            held = found if held is None else held.unionByName(found)
        if level >= 3:
            sinks.write_processed(rows, own, to)
        if args.simulation is not None:
            made = sinks.simulations(rows, own, f"{args.simulation}\n{VERSION}\n{' '.join(map(str, args.pattern))}")
            runs = made if runs is None else runs.unionByName(made)
    if held is not None:
        held = parameters.shared_cut(held)
        sinks.write_matrices(held, to)
        if level >= 2:
            held.write.mode("overwrite").parquet(f"{args.output}/final")
            sinks.final_values(calls, f"{args.output}/state")
    if runs is not None:
        to.text(runs, "runfile", ["block"])


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    levels = {"none": 100, "fatal": 50, "error": 40, "warning": 30, "information": 20, "debug": 10}
    logging.basicConfig(filename=args.logfile, level=levels[args.loglevel])
    builder = SparkSession.builder.appName("fluorspark")
    if args.partitions:
        builder = builder.config("spark.sql.shuffle.partitions", args.partitions)
    run(builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
