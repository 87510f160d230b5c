"""Artefacts that queries share: written once for a state of their inputs, then read."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _state(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of a table's files: it changes when the table does."""
    fs, p = _fs(spark, path)
    files = fs.listStatus(p) if fs.getFileStatus(p).isDirectory() else [fs.getFileStatus(p)]
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def _folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_ranksmith_artefacts", None)
    if not at:
        at = spark._ranksmith_artefacts = tempfile.mkdtemp(prefix="ranksmith-store-")
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    except Exception:  # the session has ended
        pass


def stored(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], make: Callable[[], DataFrame], by: tuple[str, ...]) -> DataFrame:
    """make(), kept as Parquet in ranges of `by` and sorted by it, so that a filter on its first
    columns reads few row groups. A common first column is split by those after it. Tables that
    have changed since are read again; what was kept for them goes, as all does at the end."""
    kept = spark.__dict__.setdefault("_ranksmith_kept", {})
    now = tuple(_state(spark, f"{sf_dir}/{t}.parquet") for t in tables)
    state, path, schema = kept.get((sf_dir, name), (None, None, None))
    if state != now:
        if path:
            _delete(spark, path)
        path = f"{_folder(spark)}/ranksmith-{name}-{uuid.uuid4().hex}"
        df = make()
        schema = df.schema
        df.repartitionByRange(*by).sortWithinPartitions(*by).write.option("compression", "zstd").parquet(path)
        atexit.register(_delete, spark, path)
        kept[sf_dir, name] = now, path, schema
    return spark.read.schema(schema).parquet(path)
