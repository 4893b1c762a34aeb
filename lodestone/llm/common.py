"""What the operators of this subpackage share: shared storage, Arrow maps, words, row filters."""

from __future__ import annotations

import ctypes
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import table  # noqa: F401
from ..storage import discard, materialise, shared_folder  # noqa: F401

#: Rows and bytes that Arrow hands to Python at once. Texts may be long, so a batch is kept small.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def release() -> None:
    """Give memory that is free back to the system: workers live on between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(function: Callable) -> Callable:
    """``function``, of an iterator, with ``release`` once it is through."""

    def run(batches):
        yield from function(batches)
        release()

    return run


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches, unless the session has smaller bounds. A row over the bound comes alone."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(re.sub("[^0-9-]", "", conf.get(key))) <= most:
            conf.set(key, most)
    return df.mapInArrow(releasing(function), schema)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_rows(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``row``, so that no column of its can clash with one that is added."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))


def rows_again(df: DataFrame) -> DataFrame:
    """The columns that ``whole_rows`` put into ``row``."""
    return df.select("row.*")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, a null as an empty one."""
    return [x or "" for x in batch.column(column).to_pylist()]


def encoded(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The batch's texts (or those in its struct column ``row``) as UTF-8, without decoding them; a null is empty."""
    held = batch.column("row").field(column) if "row" in batch.schema.names else batch.column(column)
    return [x or b"" for x in held.cast(pa.binary()).to_pylist()]


def remainder(column, modulus: int):
    """crc32 of a key as text, modulo ``modulus``; 0 for a null key."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus)), F.lit(0)).cast("int")


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's LONG."""
    return values.view(np.int64)

