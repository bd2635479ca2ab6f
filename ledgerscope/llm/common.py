"""Helpers that several operators share: tables, cut lineage, bounded Arrow chunks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(build, sql)
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share. Only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As :func:`kept`, but as a compressed table, for larger data of which later steps read some columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literals(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table held in the plan itself."""
    names, kinds = zip(*(field.split(" ") for field in schema.split(", ")))
    structs = [F.struct(*(F.lit(value).cast(kind).alias(name) for name, kind, value in zip(names, kinds, row))) for row in rows]
    empty = F.array().cast(f"array<struct<{', '.join(f'{name}: {kind}' for name, kind in zip(names, kinds))}>>")
    return spark.range(1).select(F.inline(F.array(*structs) if structs else empty))


_SHIPPED: set[str] = set()


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with this package sent to the executors, so that their workers can import it."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="package-"), "ledgerscope.zip")
        with zipfile.ZipFile(archive, "w") as file:
            for path in sorted((root / "ledgerscope").rglob("*.py")):
                file.write(path, path.relative_to(root))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()  # a worker lives on after its task
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # what glibc has
        if trim is not None:
            trim(0)

    return df.mapInArrow(freed, schema)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts (or lists) of one piece hold ``max_bytes`` (or items) or are a single one."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        measure = pc.list_value_length if pa.types.is_list(texts.type) else pc.binary_length
        lengths = pc.fill_null(measure(texts), 0).to_pylist()
        start = size = 0
        for row, length in enumerate(lengths):
            if size and size + length > max_bytes:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += length
        if batch.num_rows > start:
            yield batch.slice(start)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that clashes with none of ``taken`` (case-insensitively)."""
    used = {other.lower() for other in taken}
    while name.lower() in used:
        name += "_"
    return name


_LOADED: dict[object, tuple] = {}


def loaded(kind, *args):
    """Made once in each worker process and kept until another one of its kind is asked for."""
    if _LOADED.get(kind, (None,))[0] != args:
        _LOADED.pop(kind, None)
        _LOADED[kind] = (args, kind(*args))
    return _LOADED[kind][1]
