"""Binary intensity files as Spark data sources, and their bytes.

A file has a header of 13 bytes (the letters CIF, version, bytes of a value, first cycle, cycles, clusters)
and then, for each cycle and channel, the values of all clusters. The driver knows names and sizes only: a tile
is dealt to tasks as shares of its clusters, a task reads the headers of its own tile's files and then its byte range of every wanted cycle
and channel, and nothing of cycles that were not asked for. Filters on lane, tile and cluster reach the source where the session lets Python sources take them. Files that end in .gz or .bz2
are read whole, by one task each.

A run folder has a file for each cycle. A task reads its clusters from all cycles' files: no cluster's cycles have to meet in a shuffle. Cycles stand at their own place; a
cycle that is missing is zeros and marked in ``valid``, which is null for tiles that have all of theirs.
"""

from __future__ import annotations

import json
import logging
import operator
import re
import struct
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack, contextmanager
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fluorspark.model import CHANNELS, INT_MAX, INT_MIN

HEADER = struct.Struct("<3sBBHHI")
KINDS = {1: "<i1", 2: "<i2", 4: "<i4"}
SCHEMA = "file string, first_cycle int, lane int, tile int, cluster_idx long, x long, y long, signal array<smallint>"
FOLDER_SCHEMA = "lane int, tile int, cluster_idx long, x long, y long, signal array<smallint>, valid array<boolean>"
BYTES_A_TASK = 64 << 20
ROWS_A_BATCH = 8192


def header(raw: bytes) -> tuple[int, int, int, int]:
    """Bytes of a value, first cycle, cycles and clusters."""
    magic, version, width, first, cycles, clusters = HEADER.unpack(raw[: HEADER.size])
    if magic != b"CIF" or version != 1 or width not in KINDS:
        raise ValueError(f"no intensity file: {magic!r}, version {version}, {width} bytes a value")
    return width, first, cycles, clusters


def coordinates(idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions along a triangle for clusters whose file has none."""
    x = np.floor((1 + np.sqrt(1 + 8 * idx.astype(np.float64))) / 2).astype(np.int64)
    return x, 1 + idx - x * (x - 1) // 2


def opened_store(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the name in it of a path, with or without a scheme."""
    return fs.FileSystem.from_uri(path if ":" in path.split("/", 1)[0] else f"file://{path}")


@lru_cache(maxsize=1024)
def _unpacked(path: str) -> memoryview:
    """A compressed file's content, held until its task's tile is read."""
    store, name = opened_store(path)
    with store.open_input_stream(name, compression="detect") as stream:
        return memoryview(stream.read())


@contextmanager
def _opened(path: str) -> Iterator[Callable[[int, int], bytes]]:
    """A function (bytes, offset) -> content of a file; compressed files are read whole."""
    store, name = opened_store(path)
    if path.endswith((".gz", ".bz2")):
        whole = _unpacked(path)
        yield lambda n, at: whole[at : at + n]
    else:
        with store.open_input_file(name) as file:
            yield file.read_at


def _values(path: str, begin: int, end: int, wanted: Sequence[int] | None = None) -> np.ndarray:
    """The values (clusters x 4C) of a file's clusters from ``begin`` to ``end``, of all its cycles or of those ``wanted``, counted from 0 in the file."""
    with _opened(path) as read:
        width, _, held, clusters = header(bytes(read(HEADER.size, 0)))
        wanted = range(held) if wanted is None else wanted
        out = np.empty((end - begin, len(wanted) * CHANNELS), dtype=np.int64)
        for k, cycle in enumerate(wanted):
            for ch in range(CHANNELS):
                at = HEADER.size + ((cycle * CHANNELS + ch) * clusters + begin) * width
                out[:, k * CHANNELS + ch] = np.frombuffer(read((end - begin) * width, at), dtype=KINDS[width])
    return out


def _header_of(path: str) -> tuple[int, int, int, int]:
    with _opened(path) as read:
        return header(bytes(read(HEADER.size, 0)))


def cycles_of(path: str) -> int:
    """The cycles of a file; 0 if it cannot be opened."""
    try:
        return _header_of(path)[2]
    except (OSError, ValueError, struct.error):
        return 0


def _shares(size: int, packed: bool) -> int:
    """Into how many tasks a tile's bytes are dealt."""
    return 1 if packed else max(1, -(-size // BYTES_A_TASK))


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as lists, from flat values and offsets."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel(), kind))


def _signals(values: np.ndarray) -> pa.Array:
    return _lists(np.clip(values, INT_MIN, INT_MAX).astype(np.int16), pa.int16())


def lane_tile(path: str) -> tuple[int, int]:
    """The first two numbers of a file name that an underscore joins; 0 if there are none."""
    m = re.search(r"([0-9]+)_([0-9]+)", path.rsplit("/", 1)[-1])
    return (int(m[1]), int(m[2])) if m else (0, 0)


class _Part(InputPartition):
    def __init__(self, *value: object) -> None:
        super().__init__(value)


class _Reader(DataSourceReader):
    """What both readers share: wanted cycles and clusters, and the cut of the work into shares of tiles.

    Options: ``cycles`` (a JSON list of cycle numbers from 1, in ascending order, or how many of the first; all if empty or 0), ``from`` and ``to`` (clusters, half open). A reader that goes to
    tasks holds no paths: each partition brings its own tile's.
    """

    def __init__(self, options: dict) -> None:
        cycles = json.loads(options.get("cycles", "[]"))
        self.cycles: list[int] = cycles if isinstance(cycles, list) else list(range(1, cycles + 1))
        self.clusters = [int(options.get("from", 0)), int(options.get("to", 1 << 62))]
        self.places: dict[str, list] = {"lane": [], "tile": []}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("paths", "tiles")}

    def wants(self, lane: int, tile: int) -> bool:
        return all(use(at) for name, at in (("lane", lane), ("tile", tile)) for use in self.places[name])

    def share(self, clusters: int, k: int, of: int) -> tuple[int, int]:
        begin, end = clusters * k // of, clusters * (k + 1) // of
        return max(begin, self.clusters[0]), min(end, self.clusters[1])

    def batches(self, begin: int, end: int, values: Callable[[int, int], np.ndarray], fixed: dict[str, pa.Scalar]) -> Iterator[pa.RecordBatch]:
        for at in range(begin, end, ROWS_A_BATCH):
            to = min(end, at + ROWS_A_BATCH)
            idx = np.arange(at, to)
            x, y = coordinates(idx)
            columns = {**{n: pa.repeat(v, to - at) for n, v in fixed.items()}, "cluster_idx": pa.array(idx), "x": pa.array(x), "y": pa.array(y), "signal": _signals(values(at, to))}
            yield pa.RecordBatch.from_arrays([columns[n] for n in self.names], names=self.names)
        _unpacked.cache_clear()


class _Pushed:
    """Takes filters on lane, tile and cluster; others stay with Spark."""

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        compare = {"EqualTo": operator.eq, "GreaterThan": operator.gt, "GreaterThanOrEqual": operator.ge, "LessThan": operator.lt, "LessThanOrEqual": operator.le, "In": lambda a, b: a in b}
        for f in filters:
            kind, name = type(f).__name__, ".".join(f.attribute) if hasattr(f, "attribute") else ""
            value = getattr(f, "value", None)
            if name in self.places and kind in compare and value is not None:
                self.places[name].append(partial(_holds, compare[kind] if kind != "In" else _among, value))
            elif name == "cluster_idx" and kind in ("EqualTo", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual"):
                if kind in ("EqualTo", "GreaterThan", "GreaterThanOrEqual"):
                    self.clusters[0] = max(self.clusters[0], value + (kind == "GreaterThan"))
                if kind in ("EqualTo", "LessThan", "LessThanOrEqual"):
                    self.clusters[1] = min(self.clusters[1], value + (kind != "LessThan"))
            else:
                yield f


def _holds(compare: Callable, value: object, at: int) -> bool:
    return compare(at, value)


def _among(at: int, values: tuple) -> bool:
    return at in values


class _FileReader(_Reader):
    """Reads files of all cycles (option ``path``, names joined by commas); what cannot be opened or is no intensity file is skipped with a warning, as is a file that lacks a wanted cycle."""

    names = tuple(f.split()[0] for f in SCHEMA.split(", "))

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.paths = options["path"].split(",")

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            if self.wants(*lane_tile(path)):
                packed = path.endswith((".gz", ".bz2"))
                shares = _shares(0 if packed else _size(path), packed)
                out += [_Part(path, k, shares) for k in range(shares)]
        return out or [_Part("", 0, 1)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, k, of = partition.value
        if not path:
            return
        try:
            _, first, held, clusters = _header_of(path)
        except (OSError, ValueError, struct.error) as e:
            logging.getLogger("fluorspark").warning("skipped %s: %s", path, e)
            return
        wanted = [c - 1 for c in self.cycles] or list(range(held))
        if max(wanted, default=0) >= max(held, 1):
            logging.getLogger("fluorspark").warning("skipped %s: %d cycles", path, held)
            return
        lane, tile = lane_tile(path)
        fixed = {"file": pa.scalar(path), "first_cycle": pa.scalar(first, pa.int32()), "lane": pa.scalar(lane, pa.int32()), "tile": pa.scalar(tile, pa.int32())}
        yield from self.batches(*self.share(clusters, k, of), lambda a, b: _values(path, a, b, wanted), fixed)


class _FolderReader(_Reader):
    """Reads tiles of a run folder (option ``tiles``: a JSON list of lane, tile, files and their bytes; ``width``: how many cycles a tile has at least)."""

    names = tuple(f.split()[0] for f in FOLDER_SCHEMA.split(", "))

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.tiles = json.loads(options["tiles"])
        self.width = int(options.get("width", 0))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for lane, tile, paths, size in self.tiles:
            if self.wants(lane, tile):
                shares = _shares(size, any(p.endswith((".gz", ".bz2")) for p in paths))
                out += [_Part(lane, tile, paths, k, shares) for k in range(shares)]
        return out or [_Part(0, 0, [], 0, 1)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        lane, tile, paths, k, of = partition.value
        if not paths:
            return
        try:
            with ThreadPoolExecutor(8) as pool:
                heads = list(pool.map(_header_of, paths))
        except (OSError, ValueError, struct.error) as e:
            raise ValueError(f"lane {lane} tile {tile}: {e}") from e
        if len({(h[0], h[3]) for h in heads}) > 1:
            raise ValueError(f"lane {lane} tile {tile}: files differ in value size or number of clusters")
        places = [c for h in heads for c in range(h[1], h[1] + h[2])]
        if min(places) < 1 or len(set(places)) < len(places):
            raise ValueError(f"lane {lane} tile {tile}: cycles below 1 or given twice")
        cycles = self.cycles or list(range(1, max(self.width, *places) + 1))
        at = {c: k for k, c in enumerate(cycles)}
        valid = [c in set(places) for c in cycles]

        def values(begin: int, end: int) -> np.ndarray:
            out = np.zeros((end - begin, len(cycles) * CHANNELS), dtype=np.int64)
            for path, (_, first, held, _) in zip(paths, heads, strict=True):
                own = [c for c in range(first, first + held) if c in at]
                if own:
                    columns = np.concatenate([np.arange(CHANNELS) + at[c] * CHANNELS for c in own])
                    out[:, columns] = _values(path, begin, end, [c - first for c in own])
            return out

        fixed = {"lane": pa.scalar(lane, pa.int32()), "tile": pa.scalar(tile, pa.int32()), "valid": pa.scalar(None if all(valid) else valid, pa.list_(pa.bool_()))}
        yield from self.batches(*self.share(heads[0][3], k, of), values, fixed)


class _PushedFileReader(_Pushed, _FileReader):
    pass


class _PushedFolderReader(_Pushed, _FolderReader):
    pass


def _size(path: str) -> int:
    store, name = opened_store(path)
    return store.get_file_info(name).size or 0


class FolderSource(DataSource):
    """``spark.read.format("intensity_folder").option("tiles", json)`` after registration; see ``_FolderReader``."""

    @classmethod
    def name(cls) -> str:
        return "intensity_folder"

    def schema(self) -> str:
        return FOLDER_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_PushedFolderReader if self.options.get("pushdown") == "true" else _FolderReader)(self.options)


class CifSource(DataSource):
    """``spark.dataSource.register(CifSource)``, then ``spark.read.format("intensity").option("path", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "intensity"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_PushedFileReader if self.options.get("pushdown") == "true" else _FileReader)(self.options)


def load(spark: SparkSession, kind: type[DataSource], cycles: Sequence[int] = (), **options: str) -> DataFrame:
    """The rows of a source; filters are pushed where ``spark.sql.python.filterPushdown.enabled`` is set."""
    spark.dataSource.register(kind)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(kind.name()).options(cycles=json.dumps(list(cycles)), pushdown=pushdown.lower(), **options).load()


def stitched(cycles: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters whose cycles stand in rows of their own: the signals of a cluster joined in the order of ``first_cycle``, without gaps. A run folder's source needs no such shuffle."""
    parts = F.array_sort(F.collect_list(F.struct("first_cycle", "signal")))
    return cycles.groupBy(*keys, "cluster_idx").agg(F.flatten(F.transform(parts, lambda p: p["signal"])).alias("signal"))


def encoded(values: np.ndarray, width: int = 2, first: int = 1) -> bytes:
    """A tile (clusters x 4C reals, in order) as a file's bytes: rounded half away from zero and saturated."""
    info = np.iinfo(KINDS[width])
    whole = np.clip(np.trunc(values + np.copysign(0.5, values)), info.min, info.max).astype(KINDS[width])
    return HEADER.pack(b"CIF", 1, width, first, values.shape[1] // CHANNELS, len(values)) + whole.T.tobytes()


def interleaved(parts: list[tuple[str, int]], write: Callable[[bytes], object]) -> None:
    """A tile's file from parts (path, clusters) that are such files of ranges of its clusters, in order: column by column, a range at a time."""
    width, first, cycles, _ = _header_of(parts[0][0])
    write(HEADER.pack(b"CIF", 1, width, first, cycles, sum(n for _, n in parts)))
    with ExitStack() as stack:
        readers = [(stack.enter_context(_opened(path)), n) for path, n in parts]
        for k in range(cycles * CHANNELS):
            for read, n in readers:
                write(bytes(read(n * width, HEADER.size + k * n * width)))


def write(clusters: DataFrame, folder: str, keys: tuple[str, ...] = ("lane", "tile"), width: int = 2, names: Column | None = None) -> DataFrame:
    """Writes a file for each tile, the unit of the format; returns ``keys``, ``file`` and ``clusters``. Names are those of ``names`` or ``s_`` and the keys.

    Tasks write ranges of a tile's clusters; a tile's file is put together from them by a task that holds one range of one column, and
    all files get their names at once when all are there (see ``named``).
    """
    from fluorspark.sources import named

    name = F.concat(F.concat_ws("_", F.lit("s"), *keys), F.lit(".cif")) if names is None else names
    rows = clusters.select(*keys, name.alias("file"), "cluster_idx", "signal")
    named.write_intensities(rows, folder, width)
    return rows.groupBy(*keys, "file").agg(F.count("*").alias("clusters"))
