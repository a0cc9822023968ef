"""What all executors share: checkpoints, and fitted parameters as a file for each step and tile."""

from __future__ import annotations

import functools
import io
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from fluorspark.model import Params


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of its own where the session is a single machine's and names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def shared_cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@functools.lru_cache(maxsize=16)
def _load(folder: str, step: str, tile: int, kind: type = Params):
    store, base = fs.FileSystem.from_uri(folder)
    name = f"{base}/{step}/{tile}.npz"
    if store.get_file_info(name).type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(name) as file:
        held = np.load(io.BytesIO(file.read()))
    return kind(**{k: held[k] if held[k].ndim else float(held[k]) for k in held.files})


class BlockFiles:
    """The parameters of one block of a fit whose keys are tile * blocks + block."""

    def __init__(self, files: ParameterFiles, blocks: int, block: int) -> None:
        self.files, self.blocks, self.block = files, blocks, block

    def __iter__(self) -> Iterator[int]:
        return (k // self.blocks for k in self.files if k % self.blocks == self.block)

    def __getitem__(self, tile: int) -> Params | None:
        return self.files[tile * self.blocks + self.block]


class ParameterFiles:
    """Parameters that tasks write, tile by tile, and other tasks read as they need them: none passes through the driver.

    The first file of a step and tile stays, and attempts beside each other write the same numbers, as sums are added up in the order of their tasks.
    A tile without a file has no parameters. ``kind`` is the parameters' data class.
    """

    def __init__(self, spark: SparkSession, kind: type = Params) -> None:
        self.folder, self.last, self.kind = f"{shared_folder(spark).rstrip('/')}/fit-{uuid.uuid4().hex}", "", kind

    def put(self, step: str, tile: int, params) -> None:
        store, base = fs.FileSystem.from_uri(self.folder)
        name = f"{base}/{step}/{tile}.npz"
        if store.get_file_info(name).type != fs.FileType.NotFound:
            return
        raw = io.BytesIO()
        np.savez(raw, **{k: v for k, v in vars(params).items() if v is not None})
        store.create_dir(f"{base}/{step}")
        part = f"{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(raw.getvalue())
        store.move(part, name)

    def get(self, step: str, tile: int):
        return _load(self.folder, step, int(tile), self.kind)

    def __iter__(self) -> Iterator[int]:
        """The tiles that have parameters after the last step."""
        store, base = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(f"{base}/{self.last}", allow_not_found=True))
        return iter(sorted(int(x.base_name.removesuffix(".npz")) for x in found if x.base_name.endswith(".npz")))

    def __getitem__(self, tile: int):
        """The parameters of the last step."""
        return self.get(self.last, tile)
