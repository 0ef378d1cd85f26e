"""Where long jobs cut their lineage."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_caches: dict[str, Callable[[], None]] = {}


def cache_of(name: str, clear: Callable[[], None]) -> None:
    """Registers how the caches that an operator keeps in its Python workers are dropped."""
    _caches[name] = clear


def turn_to(name: str) -> None:
    """Drops what other operators keep in this worker: workers outlive the stages of a job, and each should hold one stage's caches."""
    for other, clear in _caches.items():
        if other != name:
            clear()


def give_back() -> None:
    """Returns memory that this worker has freed to the machine; C libraries that can't do so keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function whose worker gives memory back at its end: an executor's idle workers stay beside those that work."""

    @wraps(work)
    def tidied(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return tidied


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a local one only where none is set, as in tests."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="zephyrlake-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: written to the shared folder, so that lost executors cost no more than a reread."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
