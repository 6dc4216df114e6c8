"""Columns, tasks and workers of the operators; their tables and files are in ``sources.scratch``."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, open_in, open_out, shared_root  # noqa: F401


def unused(name: str, columns: list[str]) -> str:
    """A column name that a table does not have, whatever it has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    """A column's name as ``F.col`` reads it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def spread(files: DataFrame, size: str, most: int) -> DataFrame:
    """A table of files, dealt to as many tasks as their sizes ask for: a file to a task while
    there are few, and about ``most`` (in the unit of the column ``size``) when there are many."""
    found = files.agg(F.count("*").alias("n"), F.sum(size).alias("size")).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(1, min(found["n"], max(4 * cores, -(-(found["size"] or 0) // most)))))


def lean(function: Callable) -> Callable:
    """A function for ``mapInArrow`` that gives freed memory back to the system at a partition's
    end, since Spark keeps the Python workers of one stage, and what they hold, for the next."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return run


def slices(batches, rows: int = 512):
    """Batches of at most so many rows, so that copies of their values are small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
