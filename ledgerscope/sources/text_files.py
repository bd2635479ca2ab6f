"""A Spark data source that writes many text files from their pieces, each piece at its place.

Rows are ``(name, at, piece)``: the file, the byte where the piece starts, and its text. Any task
may write any piece, so a file of any size is written by many tasks and none holds it whole. All tasks write
into one staging folder beside the target; writing a piece again, as a second attempt of a task does, changes
nothing. Only the commit moves files to the target, after it has compared the bytes on disk with those written; when a
task fails for good the staging folder goes and the target is as it was.

The target must be on a file system that all executors mount, as others cannot write at a place.
"""

from __future__ import annotations

import os
import shutil
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ledgerscope.errors import SourceError
from ledgerscope.sources.scratch import mounted

FORMAT = "pieced_text"
COLUMNS = ("name", "at", "piece")

# Executors get the classes of this module by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Written(WriterCommitMessage):
    partition: int
    size: int


class PiecedWriter(DataSourceArrowWriter):
    def __init__(self, target: str, overwrite: bool):
        self.target, self.overwrite = target.rstrip("/"), overwrite
        self.staging = f"{self.target}.{uuid.uuid4().hex}.staging"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        size, open_name, file = 0, None, None
        try:
            for batch in iterator:
                for name, at, piece in zip(*(batch.column(c).to_pylist() for c in COLUMNS)):
                    if name != open_name:
                        if file is not None:
                            os.close(file)
                        open_name, file = name, os.open(f"{self.staging}/{name}", os.O_WRONLY | os.O_CREAT, 0o644)
                    data = piece.encode()
                    done = 0
                    while done < len(data):
                        done += os.pwrite(file, data[done:], at + done)
                    size += len(data)
        finally:
            if file is not None:
                os.close(file)
        return Written(TaskContext.get().partitionId(), size)

    def commit(self, messages: list[Written | None]) -> None:
        with os.scandir(self.staging) as files:
            found = sum(file.stat().st_size for file in files)
        if found != sum(message.size for message in messages if message is not None):
            shutil.rmtree(self.staging)
            raise RuntimeError("pieces of the files are missing or overlap")
        if os.path.isdir(self.target) and self.overwrite:
            before = f"{self.staging}.before"
            os.rename(self.target, before)
            os.rename(self.staging, self.target)
            shutil.rmtree(before)
        elif os.path.isdir(self.target):
            with os.scandir(self.staging) as files:
                for file in files:
                    os.replace(file.path, f"{self.target}/{file.name}")
            os.rmdir(self.staging)
        else:
            os.rename(self.staging, self.target)

    def abort(self, messages: list[Written | None]) -> None:
        """Takes the folder away before it is emptied, so that tasks that still run can put nothing more into it."""
        if os.path.isdir(self.staging):
            os.rename(self.staging, f"{self.staging}.gone")
            shutil.rmtree(f"{self.staging}.gone")


class PiecedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, at bigint, piece string"

    def writer(self, schema: StructType, overwrite: bool) -> PiecedWriter:
        writer = PiecedWriter(self.options["path"], overwrite)
        os.makedirs(writer.staging)  # here only: a task that comes late must not make it anew
        return writer


def write_pieces(pieces: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes ``pieces`` (name, at, piece) as files in the folder ``path``.

    Files of the same name are replaced; with ``overwrite`` all other files of the folder go as well. Names are plain file names.
    """
    missing = [name for name in COLUMNS if name not in pieces.columns]
    if missing:
        raise SourceError(f"pieces need the columns {', '.join(missing)}")
    pieces.sparkSession.dataSource.register(PiecedText)
    writer = pieces.select(*COLUMNS).write.format(FORMAT).option("path", os.path.abspath(mounted(path)))
    writer.mode("overwrite" if overwrite else "append").save()
