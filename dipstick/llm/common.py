"""Helpers that several operators of this folder share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipstick.session import materialise

# White space as the contracts define it, in a Java pattern and for Python's bytes.split().
WHITE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Bytes of an Arrow batch of whole texts. The JVM holds a batch twice, as vectors and as a message, in buffers that double.
TEXT_BATCH = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def by_value(module: str) -> None:
    """Send a module's functions to the workers by value: executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def kept(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage ends there, sizes are known.

    With ``texts`` rows go to Python in batches of ``TEXT_BATCH`` bytes, unless the session names a size of its own.
    """
    conf = df.sparkSession.conf
    if not texts or conf.get(_BATCH_BYTES, None) is not None:
        return materialise(df, name)
    conf.set(_BATCH_BYTES, str(TEXT_BATCH))
    try:
        return materialise(df, name)
    finally:
        conf.unset(_BATCH_BYTES)


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def worker_memo(key, make: Callable):
    """What ``make`` returned for ``key`` the first time in this Python worker, which serves many tasks.

    One operator's keys are equal or start alike; what others left in the worker is dropped.
    """
    store = sys.modules.setdefault("_dipstick_worker", types.ModuleType("_dipstick_worker")).__dict__.setdefault("memo", {})
    if key not in store:
        owner = lambda k: k[0] if isinstance(k, tuple) else k
        for other in [k for k in store if owner(k) != owner(key)]:
            del store[other]
        store[key] = make()
    return store[key]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches cut into small ones, so that a task holds few texts as Python objects at a time.

    At the end Arrow gives back what it holds unused: the worker lives on.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()
