"""Files under names of their own, one for each tile and block, as a data source that commits.

Rows are first written as parts: every task writes what it has of a file, in order, to a path of its own in a work folder, and the paths that
come back are cut to the shared folder, so that of several attempts one counts. The sink's tasks then put each file together
from its parts, a piece at a time, beside its final place. Only when all tasks are done are the
files moved to their names; if one fails, nothing has a name and what was written is removed.
"""

from __future__ import annotations

import bz2
import gzip
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from fluorspark.operators.parameters import shared_cut, shared_folder
from fluorspark.sources import cif

#: Rows of a part at most.
ROWS_A_PART = 65536
COPY = 1 << 20
_PACK = {"gz": gzip.compress, "bz2": bz2.compress}


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    return cif.opened_store(folder)


def _parts(rows: DataFrame, columns: list[str], order: list[str], encode: Callable[[pa.RecordBatch], bytes], rows_a_part: int | None = None) -> DataFrame:
    """``file``, ``at`` (the place of a part's first row), ``rows`` and ``path`` of the parts written; rows of a file in ``order``."""
    spark = rows.sparkSession
    work = f"{shared_folder(spark).rstrip('/')}/parts-{uuid.uuid4().hex}"
    limit = rows_a_part or ROWS_A_PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(work)
        store.create_dir(base)
        held: list[pa.RecordBatch] = []

        def put() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            path = f"{work}/{uuid.uuid4().hex}"
            with store.open_output_stream(f"{base}/{path.rsplit('/', 1)[-1]}", compression=None) as out:
                out.write(encode(whole))
            first = [whole.column(c)[:1] for c in order]
            return pa.RecordBatch.from_arrays([whole.column("file")[:1], *first, pa.array([len(whole)], pa.int64()), pa.array([path])], names=["file", *order, "rows", "path"])

        for batch in batches:
            names = batch.column("file").to_pylist()
            begin = 0
            for k in range(1, len(names) + 1):
                if k == len(names) or names[k] != names[k - 1]:
                    own = batch.slice(begin, k - begin)
                    if held and held[0].column("file")[0].as_py() != names[begin]:
                        yield put()
                    while own.num_rows:
                        room = limit - sum(map(len, held))
                        held.append(own.slice(0, room))
                        own = own.slice(room)
                        if sum(map(len, held)) >= limit:
                            yield put()
                    begin = k
        if held:
            yield put()

    kinds = dict(rows.dtypes)
    schema = ", ".join(["file string", *(f"{c} {kinds[c]}" for c in order), "rows long", "path string"])
    dealt = rows.select("file", *order, *(c for c in columns if c not in order)).repartitionByRange("file", *order).sortWithinPartitions("file", *order)
    made = shared_cut(dealt.mapInArrow(run, schema))
    # a file has as many parts as tasks and limits cut it into: some for each gigabyte
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, "path", "rows"))), lambda p: F.struct(p["path"].alias("path"), p["rows"].alias("rows")))
    return made.groupBy("file").agg(listed.alias("parts"))


@dataclass
class Written(WriterCommitMessage):
    """What a task has put together: temporary and final paths."""

    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.folder, self.kind = options["path"], options["kind"]
        self.append = options.get("append", "false") == "true"
        self.run = options["run"]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, base = store_of(self.folder)
        done: list[tuple[str, str]] = []
        work = f"{base}/_temporary-{self.run}"
        store.create_dir(work)
        for row in iterator:
            final = f"{base}/{row['file']}"
            temporary = f"{work}/{uuid.uuid4().hex}"
            with store.open_output_stream(temporary, compression=None) as out:
                if self.append and store.get_file_info(final).type == fs.FileType.File:
                    _copy(store, final, out.write)
                parts = [(p["path"], p["rows"]) for p in row["parts"]]
                if self.kind == "intensities":
                    cif.interleaved(parts, out.write)
                else:
                    for path, _ in parts:
                        held, name = store_of(path)
                        _copy(held, name, out.write)
            done.append((temporary, final))
        return Written(done)

    def commit(self, messages: list) -> None:
        store, base = store_of(self.folder)
        for message in messages:
            for temporary, final in message.files if message else ():
                store.create_dir(final.rsplit("/", 1)[0])
                if store.get_file_info(final).type != fs.FileType.NotFound:
                    store.delete_file(final)
                store.move(temporary, final)
        self._clear(store, base)

    def abort(self, messages: list) -> None:
        self._clear(*store_of(self.folder))

    def _clear(self, store: fs.FileSystem, base: str) -> None:
        if store.get_file_info(f"{base}/_temporary-{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/_temporary-{self.run}")


def _copy(store: fs.FileSystem, path: str, write: Callable[[bytes], object]) -> None:
    with store.open_input_stream(path, compression=None) as source:
        while piece := source.read(COPY):
            write(piece)


class NamedFiles(DataSource):
    """The sink of files put together from parts; see ``write_text`` and ``write_intensities``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file string, parts array<struct<path:string,rows:long>>"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def _commit(spark: SparkSession, parts: DataFrame, folder: str, **options: str) -> None:
    spark.dataSource.register(NamedFiles)
    # a file for each row, and files are few: they are dealt by name, so that none waits behind many others
    parts.repartition("file").write.format("named_files").options(path=folder, run=uuid.uuid4().hex, **options).mode("append").save()


def write_text(rows: DataFrame, folder: str, order: list[str], packed: str = "", append: bool = False) -> None:
    """Writes the lines ``value`` of each ``file`` in ``order``; ``packed`` is gz or bz2: parts are members of the compressed file.

    An existing file is replaced; with ``append`` the lines follow what it holds.
    """

    def encode(batch: pa.RecordBatch) -> bytes:
        data = "".join(f"{v}\n" for v in batch.column("value").to_pylist()).encode()
        return _PACK[packed](data) if packed else data

    _commit(rows.sparkSession, _parts(rows, ["value"], order, encode), folder, kind="text", append=str(append).lower())


def write_intensities(rows: DataFrame, folder: str, width: int = 2) -> None:
    """Writes ``signal`` of each ``file``, clusters in order, as binary intensity files; their first cycle is 1 or, if there is such a column, ``first_cycle``."""
    first = ["first_cycle"] if "first_cycle" in rows.columns else []

    def encode(batch: pa.RecordBatch) -> bytes:
        signal = batch.column("signal")
        return cif.encoded(signal.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(signal), -1), width, batch.column("first_cycle")[0].as_py() if first else 1)

    _commit(rows.sparkSession, _parts(rows, ["signal", *first], ["cluster_idx"], encode), folder, kind="intensities")

