"""What several operators share: words of a text, work on Arrow batches, tables kept between jobs."""

from __future__ import annotations

import functools
import itertools
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

import tillbook

#: Rows handled at once inside a task; bounds what a task holds besides Spark's batch.
SLICE_ROWS = 512


def _word_byte(code: int) -> int:
    if 0x41 <= code <= 0x5A:
        return code + 32
    return code if 0x30 <= code <= 0x39 or 0x61 <= code <= 0x7A or code >= 0x80 else 0x20


_WORD_BYTES = bytes(map(_word_byte, range(256)))


def words(text: str | None) -> list[bytes]:
    """ASCII letters in lower case, digits and all characters beyond ASCII make words; UTF-8."""
    return [] if text is None else text.encode("utf-8", "replace").translate(_WORD_BYTES).split()


@functools.cache
def _shipped(application: str) -> None:
    """Make this package importable in the tasks of the running application."""
    package = Path(tillbook.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="tillbook-")) / "tillbook_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    SparkContext.getOrCreate().addPyFile(str(archive))


def hidden(frame: DataFrame, *names: str) -> list[str]:
    """The names, or longer ones where the frame has such a column, for columns that the result doesn't show."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def ship_package(spark: SparkSession) -> None:
    _shipped(spark.sparkContext.applicationId)


def map_batches(frame: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """``mapInArrow`` with a function that may use this package."""
    ship_package(frame.sparkSession)
    return frame.mapInArrow(run, schema)


def map_slices(
    frame: DataFrame, ddl: str, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]]
) -> DataFrame:
    """Rows made from slices of rows: ``make`` runs once a task, what it returns once a slice.

    The result has the columns of ``ddl`` only, so other columns of the input can't clash.
    """
    schema = StructType.fromDDL(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, work = to_arrow_schema(schema), make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                columns = work(batch.slice(start, SLICE_ROWS))
                arrays = [pa.array(columns[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return map_batches(frame, run, schema)


def add_columns(
    frame: DataFrame, ddl: str, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]]
) -> DataFrame:
    """The rows of ``frame`` with the columns of ``ddl``, which replace columns of the same names."""
    added = StructType.fromDDL(ddl)
    names = {f.name.lower() for f in added}
    schema = StructType([f for f in frame.schema if f.name.lower() not in names] + added.fields)
    first = [i for i, f in enumerate(frame.schema) if f.name.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, work = to_arrow_schema(schema), make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                columns = work(part)
                new = [pa.array(columns[f.name], arrow.field(f.name).type) for f in added]
                arrays = [part.column(i).cast(arrow.field(k).type) for k, i in enumerate(first)]
                yield pa.RecordBatch.from_arrays(arrays + new, schema=arrow)

    return map_batches(frame, run, schema)


def map_groups(
    frame: DataFrame,
    keys: list[str],
    order: list[str],
    columns: list[str],
    ddl: str,
    make_rows: Callable[[tuple, Iterator[tuple]], Iterator[tuple]],
) -> DataFrame:
    """Rows of ``ddl`` made from each group of ``keys`` in one task, its rows in ``order`` and read one by one.

    The function gets the key and rows of ``order`` and ``columns``. Groups must be of bounded size if it holds them.
    """
    schema = StructType.fromDDL(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(start, SLICE_ROWS)
                    yield from zip(*(part.column(c).to_pylist() for c in keys + order + columns), strict=True)

        def made() -> Iterator[tuple]:
            for key, group in itertools.groupby(rows(), lambda row: row[: len(keys)]):
                yield from make_rows(key, (row[len(keys) :] for row in group))

        for some in itertools.batched(made(), 16 * SLICE_ROWS):
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return map_batches(frame.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *order, *columns), run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a session on one machine may leave it unset; it then gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tillbook-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's own folder in the shared folder, deleted when the application ends."""
    folder = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place):
        system.mkdirs(place)
        system.deleteOnExit(place)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder; a lost executor costs no recomputation."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
