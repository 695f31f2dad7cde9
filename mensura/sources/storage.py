"""Files that tasks open by themselves, in any storage that Arrow reaches."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def located(path: str) -> tuple[fs.FileSystem, str]:
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def open_input(path: str):
    """A file for range reads; nothing is read yet."""
    system, name = located(path)
    return system.open_input_file(name)


@contextmanager
def new_file(path: str):
    """A stream whose file appears under ``path`` when it is complete, also if a task runs twice."""
    system, name = located(path)
    folder, _, last = name.rpartition("/")
    system.create_dir(folder, recursive=True)
    hidden = f"{folder}/_{uuid.uuid4().hex}-{last}"
    with system.open_output_stream(hidden) as stream:
        yield stream
    system.move(hidden, name)


def listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path`` and ``length`` of the files below ``paths``; the listing reads no content."""
    return spark.read.format("binaryFile").load(paths).select("path", "length")
