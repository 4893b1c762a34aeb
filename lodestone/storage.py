"""Shared storage for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a session in one process may go without: it gets a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` to shared storage and read it back.

    Lineage ends there, so lost executors cost no rework, and the planner knows the table's size. A ``narrow``
    table, of few bytes a row and small against its input, is written by an eighth of the shuffle's partitions,
    so that storage does not fill with tiny files.
    """
    if narrow:
        df = df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these frames. All that was computed from them must be written by now."""
    for df in frames:
        path, held = getattr(df, "_written_to", None), _written.get(df.sparkSession.sparkContext.applicationId, [])
        if path in held:
            held.remove(path)
            _delete(df.sparkSession, path)


def position(spark: SparkSession) -> int:
    """How many tables this application has written and not deleted."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def drop_since(spark: SparkSession, begin: int, keep: DataFrame) -> None:
    """Delete what was written since ``position`` was ``begin``, but for ``keep``, that all of it went into."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    held = getattr(keep, "_written_to", None)
    for path in [x for x in paths[begin:] if x != held]:
        paths.remove(path)
        _delete(spark, path)


def sweep(spark: SparkSession, keep: DataFrame | None = None) -> int:
    """Delete what this application's ``materialise`` wrote, once no result needs it. Returns how many tables went."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    held = " ".join(keep.inputFiles()) if keep is not None else ""
    gone = 0
    for path in paths:
        if path.rsplit("/", 1)[-1] in held:
            _written.setdefault(spark.sparkContext.applicationId, []).append(path)
        else:
            gone += _delete(spark, path)
    return gone
